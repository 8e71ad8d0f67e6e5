"""Rule packs that come with the library, a file for each rule."""

"""Tables in and out: feeds, API pages, raw pages, files, versioned corpus tables."""

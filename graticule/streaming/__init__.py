"""Event streams: an extension beyond batch operators."""

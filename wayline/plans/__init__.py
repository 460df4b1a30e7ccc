"""Named plans."""

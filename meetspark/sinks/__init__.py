"""Writers of corpus files."""

"""Library entry, command line and whole-document reports."""

"""Files and versioned datasets."""

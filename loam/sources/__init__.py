"""Files of a store: atomic publishing on any Hadoop file system."""

"""Part of the usage accounting library."""

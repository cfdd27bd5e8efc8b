"""Header-evidence analytics on Spark: sources, operators, functions and plans as DataFrame programs."""

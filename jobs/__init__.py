"""Jobs that run the engine over tables: `python -m jobs.<name> --help`."""

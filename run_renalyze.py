"""Launcher for spark-submit: ``spark-submit --py-files renalyze.zip run_renalyze.py <command> ...``."""

from renalyze.cli import main

if __name__ == "__main__":
    main()

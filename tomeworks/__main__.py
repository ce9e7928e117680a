import sys

from tomeworks.cli import run

sys.exit(run())

"""Entry point of the batch job for spark-submit."""

import sys

from wardflow.plans.job import main

if __name__ == "__main__":
    main(sys.argv[1:])

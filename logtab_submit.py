"""Launcher for spark-submit (which runs scripts, not modules):

    zip -r logtab.zip logtab
    spark-submit --py-files logtab.zip logtab_submit.py /logs/central.log -o /tables/central
"""

import sys

from logtab.plans.cli import main

if __name__ == "__main__":
    sys.exit(main())

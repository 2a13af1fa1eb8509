import sys

from logtab.plans.cli import main

sys.exit(main())

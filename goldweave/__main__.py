import sys

from goldweave.cli import main

sys.exit(main())

import sys

from linkweave.cli import main

sys.exit(main())

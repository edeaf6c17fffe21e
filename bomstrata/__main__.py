import sys

from bomstrata.frontend.cli import main

sys.exit(main())

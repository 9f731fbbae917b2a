import sys

from quadrille.cli import main

sys.exit(main())

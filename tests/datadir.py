"""Where the tables for tests are."""

import os

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

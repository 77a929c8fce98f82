"""Small helpers of these tests; a module name of its own, since several folders have a ``conftest``."""

SF = "/root/testdata/sf0.001"

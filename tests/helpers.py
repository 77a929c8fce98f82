"""Small helpers of the tests; a module name of its own, since several folders have a ``conftest``."""

SF = "/root/testdata/sf0.001"


def by(frame, key):
    return {r[key]: r.asDict(recursive=True) for r in frame.collect()}

from pathlib import PurePosixPath

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from folioflow.functions import paths

EDGES = [
    "report.pdf", "docs/report.pdf", "a/b/c/file.pdf", ".pdf", "..pdf", "file.", "a.pdf/", "noext", "report.v1.pdf", "a//b.pdf", "./a.pdf",
    "a/.", "a/./", "..", "a/..", "/a.pdf", "//a/b.PDF", "///a", "a/.hidden", "a/.hidden.txt", "x.tar.gz", "dir.d/file", "a\n.pdf", "é.pdf", "", "/", ".",
]


def expected_target(key, source, target):
    relative = key.removeprefix(source)
    path = PurePosixPath(relative)
    return target + str(path.with_suffix(".md")) if path.name else None


def test_names_suffixes_and_stems_follow_posix_paths(column):
    assert column(paths.file_name, EDGES) == [PurePosixPath(k).name for k in EDGES]
    assert column(paths.suffix, EDGES) == [PurePosixPath(k).suffix.lower() for k in EDGES]
    assert column(paths.stem, EDGES) == [PurePosixPath(k).stem for k in EDGES]


@pytest.mark.parametrize("source,target", [("", ""), ("docs/", "results/"), ("a/", "out/")])
def test_target_key_edges(column, source, target):
    got = column(lambda c: paths.target_key(c, source, target), EDGES)
    assert got == [expected_target(k, source, target) for k in EDGES]


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab./é \n", max_size=12), min_size=150, max_size=200))
def test_random_keys(column, keys):
    assert column(paths.suffix, keys) == [PurePosixPath(k).suffix.lower() for k in keys]
    assert column(paths.stem, keys) == [PurePosixPath(k).stem for k in keys]
    assert column(lambda c: paths.target_key(c, "a/", "out/"), keys) == [expected_target(k, "a/", "out/") for k in keys]


def test_supported_formats(column):
    keys = ["doc.pdf", "img.PNG", "photo.jpg", "scan.jpeg", "fax.tiff", "fax.tif", "readme.txt", "data.csv", "archive.zip", "noext"]
    assert column(paths.is_supported, keys) == [True] * 5 + [False] * 5


def test_content_type_and_default(column):
    names = ["a.png", "b.JPG", "c.jpeg", "d.tiff", "e.svg", "f.png.gz", "g", "h.unknown"]
    want = ["image/png", "image/jpeg", "image/jpeg", "image/tiff", "image/svg+xml", "image/png", "image/png", "image/png"]
    assert column(paths.content_type, names) == want


def test_bundle_folder_is_cut_and_prefix_drops_three(column):
    assert column(paths.bundle_folder, ["d/" + "x" * 100 + ".pdf"]) == ["x" * 80]
    assert column(paths.artifact_prefix, ["out/a.md", "md"]) == ["out/a", ""]


def test_job_id_depends_on_its_parts_only(column):
    first, second, third = column(lambda c: paths.job_id(c), ["a", "a", "b"])
    assert first == second != third and len(first) == 64


def test_image_roots_are_the_prefixes_a_listing_would_use(column):
    keys = ["out/a/images/x.png", "a/images/b/images/c.png", "images/x.png", "out/a.md", "a/images/"]
    want = [["out/a/images/"], ["a/images/", "a/images/b/images/"], [], [], ["a/images/"]]
    assert column(paths.image_roots, keys) == want

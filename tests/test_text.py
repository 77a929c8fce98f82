import re
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from folioflow.functions import text

SAMPLES = "ab \t\n\r\x00\x07\x0b\x1f\x7f\x85\x9f\xa0​‌‍‎﻿مݐࢠﭐﹰﻵﻻＡ…é\U0001f600"
strings = st.lists(st.text(alphabet=SAMPLES, max_size=20), min_size=150, max_size=200)
quick = settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])

ARABIC = re.compile("[؀-ۿݐ-ݿࢠ-ࣿﭐ-﷿ﹰ-﻿]")


@quick
@given(strings)
def test_clean_up_equals_python_regexes(column, values):
    zero, control = "[​-‍﻿]", "[\x00-\x08\x0b-\x0c\x0e-\x1f\x7f-\x9f]"
    assert column(text.drop_zero_width, values) == [re.sub(zero, "", v) for v in values]
    assert column(text.drop_control, values) == [re.sub(control, "", v) for v in values]
    assert column(text.clean, values) == [re.sub(control, "", re.sub(zero, "", v)) for v in values]
    assert column(text.has_arabic, values) == [bool(ARABIC.search(v)) for v in values]


@quick
@given(strings)
def test_nfkc_and_post_process(column, values):
    assert column(text.nfkc, values) == [unicodedata.normalize("NFKC", v) for v in values]
    want = [re.sub("[​-‍﻿\x00-\x08\x0b-\x0c\x0e-\x1f\x7f-\x9f]", "", unicodedata.normalize("NFKC", v)) for v in values]
    assert column(text.post_process, values) == want


def test_post_process_flags_and_empty(column):
    values = ["ﻻ​", "", None]
    assert column(lambda c: text.post_process(c, normalize=False), values) == ["ﻻ", "", None]
    assert column(lambda c: text.post_process(c, clean_up=False), values) == ["لا​", "", None]
    assert column(lambda c: text.post_process(c, False, False), values) == values


def test_nfkc_beats_the_ligature_table(column):
    assert column(text.nfkc, ["ﻵ", "ﻻ"]) == ["لآ", "لا"]
    assert column(text.expand_ligatures, ["ﻵﻻ", "x"]) == ["لا" * 2, "x"]


LINES = "first\nمرح\n\n  \nlast م"


@pytest.mark.parametrize("mode", ["auto", "always"])
def test_direction_fix_reorders_arabic_lines_only(column, mode):
    got = column(lambda c: text.fix_direction(c, mode, lambda s: s[::-1]), [LINES, "none", None])
    assert got == ["first\nحرم\n\n  \nم tsal", "none", None]


@pytest.mark.parametrize("mode,reorder", [("never", str.upper), ("other", str.upper), ("auto", None)])
def test_direction_fix_off(column, mode, reorder):
    assert column(lambda c: text.fix_direction(c, mode, reorder), [LINES]) == [LINES]


def test_a_failing_line_stays_as_it_is(column):
    def fussy(line):
        if "last" in line:
            raise ValueError
        return "<" + line + ">"

    assert column(lambda c: text.fix_direction(c, "auto", fussy), [LINES]) == [LINES.replace("مرح", "<مرح>")]


def test_column_and_python_line_maps_agree(column):
    from pyspark.sql import functions as F

    values = [LINES, "x\nمa\n", "م", ""]
    assert column(lambda c: text.map_arabic_lines(c, F.upper), values) == column(
        lambda c: text.fix_direction(c, "auto", str.upper), values
    )


def test_chain_applies_to_arabic_documents_only(spark):
    frame = spark.createDataFrame([("arabic", "ﻻ​"), ("en", "ﻻ​"), (None, "ﻻ​")], "lang string, md string")
    got = {r["lang"]: r["out"] for r in frame.select("lang", text.arabic_chain("md", "lang").alias("out")).collect()}
    assert got == {"arabic": "لا", "en": "ﻻ​", None: "ﻻ​"}


def test_changed_lines(spark):
    frame = spark.createDataFrame([("a\nb\nc", "a\nB\nC"), ("a", "a")], "before string, after string")
    assert [r[0] for r in frame.select(text.changed_lines("before", "after")).collect()] == [2, 0]


def rewrite(md, prefix):
    def one(match):
        if match.group(2).startswith(("http://", "https://")):
            return match.group(0)
        return f"![{match.group(1)}]({prefix}/{match.group(2).lstrip('./')})"

    return re.sub(text.IMAGE_REF, one, md)


@quick
@given(st.lists(st.text(alphabet="![]()./ht\n", max_size=30).map(lambda s: s.replace("ht", "http://")), min_size=150, max_size=200))
def test_link_rewrite_on_random_markup(column, values):
    from pyspark.sql import functions as F

    prefix = "s3://b$1\\x"
    assert column(lambda c: text.rewrite_image_links(c, F.lit(prefix)), values) == [rewrite(v, prefix) for v in values]


def test_link_rewrite_examples(column):
    from pyspark.sql import functions as F

    values = [
        "![a](images/x.png) and ![](./../y.jpg)", "![w](https://h/z.png)", "![a]()", "[no](images/x.png)", None,
        "![a](http://x/![b](c) ![d](e)", "![two\nlines](a\nb)",
    ]
    got = column(lambda c: text.rewrite_image_links(c, F.lit("P")), values)
    assert got == [None if v is None else rewrite(v, "P") for v in values]


def test_image_refs(column):
    got = column(text.image_refs, ["![a](b) ![](c/d) x", "none"])
    assert [[tuple(r) for r in refs] for refs in got] == [[("a", "b"), ("", "c/d")], []]


def test_escapes(column):
    assert column(text.escape_html, ["<a href=\"x\">'&'</a>", None]) == ["&lt;a href=&quot;x&quot;&gt;&#39;&amp;&#39;&lt;/a&gt;", ""]
    assert column(text.escape_attribute, ["<'\"&"]) == ["<&#39;&quot;&"]
    assert column(text.plain_html, ["a\n<b>"]) == ["a<br>&lt;b&gt;"]


def test_strip_dot_slash(column):
    assert column(text.strip_dot_slash, ["../i.png", "./i", "i./", "..."]) == ["i.png", "i", "i./", ""]


def test_utf8(column):
    bodies = [b"caf\xc3\xa9", b"a\xffb", b"\xe2\x82"]
    assert column(text.decode_utf8, bodies, "binary") == ["café", None, None]
    assert column(text.decode_utf8_lossy, bodies, "binary") == [b.decode("utf-8", "replace") for b in bodies]

"""Extracted-text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.functions import text
from folioflow.operators.agreement import line_agreement
from folioflow.suite import derived
from folioflow.suite.derived import sql_with
from folioflow.suite import query
from folioflow.suite.views import REWRITE_SQL

ARABIC = f"[{text.ARABIC}]"
ZERO_WIDTH, CONTROL = f"[{text.ZERO_WIDTH}]", r"[\x00-\x08\x0b-\x0c\x0e-\x1f\x7f-\x{9f}]"

# What NFKC makes of the two injected ligatures; the driver's own texts are their own NFKC form.
NFKC_SQL = "replace(replace(md, '\ufefb', '\u0644\u0627'), '\ufef5', '\u0644\u0622')"
PLAIN_SQL = "md"
for _ligature in text.LIGATURES:
    PLAIN_SQL = f"replace({PLAIN_SQL}, '{_ligature}', '{text.LAM_ALEF}')"


def _clean(sql: str) -> str:
    return f"regexp_replace(regexp_replace({sql}, '{ZERO_WIDTH}', '', 'g'), '{CONTROL}', '', 'g')"


def _lines(sql: str, change: str) -> str:
    """Line-wise ``change`` of ``x`` for lines with Arabic script."""
    return f"""array_to_string(list_transform(string_split({sql}, chr(10)),
      lambda x: case when regexp_matches(x, '{ARABIC}') then {change} else x end), chr(10))"""


def _of_artifacts(expression: str, name: str = "md") -> str:
    return sql_with("artifacts", body=f"select doc_id, {expression} as {name} from artifacts")


def flip(line: str) -> str:
    """A stand-in for a caller's reorder function."""
    return line[::-1]


@query("t1_nfkc", _of_artifacts(NFKC_SQL))
def _(spark, sf_dir):
    return derived.artifacts(spark, sf_dir).select("doc_id", text.nfkc("md").alias("md"))


@query("t2_ligatures", _of_artifacts(PLAIN_SQL))
def _(spark, sf_dir):
    return derived.artifacts(spark, sf_dir).select("doc_id", text.expand_ligatures("md").alias("md"))


@query("t3_zero_width", _of_artifacts(f"regexp_replace(md, '{ZERO_WIDTH}', '', 'g')"))
def _(spark, sf_dir):
    return derived.artifacts(spark, sf_dir).select("doc_id", text.drop_zero_width("md").alias("md"))


@query("t4_control", _of_artifacts(f"regexp_replace(md, '{CONTROL}', '', 'g')"))
def _(spark, sf_dir):
    return derived.artifacts(spark, sf_dir).select("doc_id", text.drop_control("md").alias("md"))


@query("t5_post_process", _of_artifacts(_clean(NFKC_SQL)))
def _(spark, sf_dir):
    return derived.artifacts(spark, sf_dir).select("doc_id", text.post_process("md").alias("md"))


@query("t6_arabic_script", sql_with("artifacts", body=f"select doc_id, regexp_matches(md, '{ARABIC}') as arabic from artifacts"))
def _(spark, sf_dir):
    return derived.artifacts(spark, sf_dir).select("doc_id", text.has_arabic("md").alias("arabic"))


@query("t7_line_transform", _of_artifacts(_lines("md", "concat('<', x, '>')")))
def _(spark, sf_dir):
    marked = text.map_arabic_lines("md", lambda line: F.concat(F.lit("<"), line, F.lit(">")))
    return derived.artifacts(spark, sf_dir).select("doc_id", marked.alias("md"))


@query("t8_direction_off", _of_artifacts("md"))
def _(spark, sf_dir):
    """Mode ``never``, an unknown mode and a missing reorder function all change nothing."""
    md = text.fix_direction(text.fix_direction(text.fix_direction("md", "never", flip), "other", flip), "auto")
    return derived.artifacts(spark, sf_dir).select("doc_id", md.alias("md"))


@query("t8_direction_fix", _of_artifacts(f"case when lang is null then md else {_lines('md', 'reverse(x)')} end"))
def _(spark, sf_dir):
    mode = F.when(F.col("lang") == "arabic", "always").when(F.col("lang") == "en", "auto").otherwise("never")
    return derived.artifacts(spark, sf_dir).select("doc_id", text.fix_direction("md", mode, flip).alias("md"))


@query("t9_arabic_chain", _of_artifacts(f"case when lang = 'arabic' then {_lines(_clean(NFKC_SQL), 'reverse(x)')} else md end"))
def _(spark, sf_dir):
    return derived.artifacts(spark, sf_dir).select("doc_id", text.arabic_chain("md", "lang", "auto", flip).alias("md"))


@query("p17_language_gate", _of_artifacts(f"case when lang = 'arabic' then {_clean('md')} else md end"))
def _(spark, sf_dir):
    gated = F.when(F.col("lang") == "arabic", text.clean("md")).otherwise(F.col("md"))
    return derived.artifacts(spark, sf_dir).select("doc_id", gated.alias("md"))


@query(
    "a4_change_counts",
    sql_with(
        "artifacts",
        body=f"""select lang, count(*) as docs, cast(sum(length(md)) as bigint) as chars_before, cast(sum(length(after)) as bigint) as chars_after,
          cast(sum(case when lang = 'arabic' then len(list_filter(list_zip(string_split(md, chr(10)), string_split(after, chr(10))), lambda p: p[1] <> p[2])) else 0 end) as bigint)
            as changed_lines
          from (select *, case when lang = 'arabic' then {_clean(NFKC_SQL)} else md end as after from artifacts) group by lang""",
    ),
)
def _(spark, sf_dir):
    made = derived.artifacts(spark, sf_dir).withColumn("after", text.arabic_chain("md", "lang", "never"))
    return made.groupBy("lang").agg(
        F.count("*").alias("docs"),
        F.sum(F.length("md")).alias("chars_before"),
        F.sum(F.length("after")).alias("chars_after"),
        F.sum(text.changed_lines("md", "after")).alias("changed_lines"),
    )


@query(
    "a4_line_agreement",
    sql_with(
        "artifacts",
        body="""select doc_id, n as lines_a, n as lines_b, greatest(n - 1, 0) as common, case when n > 0 then 2 * (n - 1) / (2.0 * n)::double else 1.0 end as agreement
          from (select doc_id, coalesce(len(string_split(regexp_replace(md, '\\n\\z', ''), chr(10))), 0) as n from artifacts)""",
    ),
)
def _(spark, sf_dir):
    """Each text against one that lacks its first line and has a new last one: all other lines are common, in order."""
    made = derived.artifacts(spark, sf_dir)
    lines = F.split(F.regexp_replace("md", r"\n\z", ""), "\n", -1)
    other = F.array_join(F.concat(F.slice(lines, F.lit(2), F.size(lines)), F.array(F.lit("\u00a7 new"))), "\n")
    return line_agreement(made.select("doc_id", "md", other.alias("other")), "md", "other")


@query(
    "t10_image_refs",
    sql_with(
        "artifacts",
        body=r"""select doc_id, cast(unnest(range(len(alts))) as int) as ref_no, unnest(alts) as alt, unnest(paths) as path from (select doc_id,
          regexp_extract_all(md, '!\[([^\]]*)\]\(([^)]+)\)', 1) as alts, regexp_extract_all(md, '!\[([^\]]*)\]\(([^)]+)\)', 2) as paths
          from artifacts)""",
    ),
)
def _(spark, sf_dir):
    refs = derived.artifacts(spark, sf_dir).select("doc_id", F.posexplode(text.image_refs("md")).alias("ref_no", "ref"))
    return refs.select("doc_id", "ref_no", "ref.alt", "ref.path")


@query("t11_link_rewrite", sql_with("artifacts", body=f"select doc_id, {REWRITE_SQL.format('s3://b$1/')} as md from artifacts"))
def _(spark, sf_dir):
    from folioflow.plans.views import linked_results

    made = derived.artifacts(spark, sf_dir)
    return linked_results(made, "s3://b$1/").join(made.select("target_key", "doc_id"), "target_key").select("doc_id", "md")


@query("t12_strip_dot_slash", "select doc_id, ltrim(concat('../.', text), './') as stripped from documents")
def _(spark, sf_dir):
    dotted = F.concat(F.lit("../."), "text")
    return derived.table(spark, sf_dir, "documents").select("doc_id", text.strip_dot_slash(dotted).alias("stripped"))


_ESCAPED = """replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')"""


@query("t13_escape_html", f"""select page_id, {_ESCAPED} as escaped, replace(replace(html, '"', '&quot;'), '''', '&#39;') as attribute from pages""")
def _(spark, sf_dir):
    return derived.table(spark, sf_dir, "pages").select(
        "page_id", text.escape_html("html").alias("escaped"), text.escape_attribute("html").alias("attribute")
    )


@query("t14_plain_html", f"select page_id, replace({_ESCAPED}, chr(10), '<br>') as plain from pages")
def _(spark, sf_dir):
    return derived.table(spark, sf_dir, "pages").select("page_id", text.plain_html("html").alias("plain"))

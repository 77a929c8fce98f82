"""The registered queries ``opN_<name>`` of the operators in this subpackage, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm import alignment, bpe, decontam, fingerprints, langid, merkle, pii, repeats, secrets, sharding, simhash, warc, wordbpe
from folioflow.session import materialise

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

SHARDS = 40


def query(function):
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op1_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return fingerprints.against_next(docs, fingerprints.lexicon(docs))


@query
def op2_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op3_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.place(sharding.sizes(table(spark, sf_dir, "documents")), "doc_id", [1.0] * SHARDS)
    return placed.withColumn("law", F.lit("key"))


@query
def op4_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.shown(F.col("__fp")).alias("fingerprint"), "component_id")


@query
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    words = materialise(secrets.dictionary(docs), "dictionary")
    found = materialise(secrets.described(materialise(secrets.findings(docs), "findings"), words), "described")
    labelled = found.where(~langid.held_out(F.col("doc_id"))).withColumn("label", secrets.weak_label(F.col("before"), F.col("value")))
    scored = secrets.fit(labelled).score(found)
    return scored.select(
        "doc_id", "path", "start", F.length("value").alias("length"), F.sha2("value", 256).alias("value_sha256"), "transitions", "covered", "probability",
        (F.col("probability") >= 0.5).alias("is_secret"),
    )


@query
def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.held_out(F.col("doc_id"))
    prototypes = langid.learn(docs.where(~out))
    return langid.predict(docs.select("doc_id", "text"), prototypes).select("doc_id", out.alias("held_out"), "lang_pred", "score")


@query
def op7_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(warc.responses(table(spark, sf_dir, "pages")))


@query
def op8_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_bytes=False)
    return found.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), "kept_sha256")


@query
def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary())


@query
def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents").select("doc_id", "text")))


@query
def op11_distinct_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return wordbpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.digests(table(spark, sf_dir, "documents"))


@query
def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    files = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    found = alignment.scored(table(spark, sf_dir, "documents"), *files, keep=("doc_id",))
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


def _sql(text: str) -> str:
    """A string for DuckDB."""
    return "'" + text.replace("'", "''").replace("\r", "' || chr(13) || '").replace("\n", "' || chr(10) || '") + "'"


def _warc_sql() -> str:
    def replaced(text, steps):
        for pattern, to in steps:
            text = f"regexp_replace({text}, {_sql(pattern)}, {_sql(to)}, 'g')"
        return text

    def plain(text):
        for name, sign in warc.ENTITIES:
            text = f"replace({text}, {_sql(name)}, {_sql(sign)})"
        return text

    bare = replaced("html", (warc.TAGS[0], *warc.TAGS[2:4]))
    text = plain(replaced("bare", (warc.TAGS[1], *warc.TAGS[4:])))
    text = replaced(text, warc.SPACES)
    title = plain(r"regexp_extract(bare, '(?is)<title\b[^<>]*>([^<]*)', 1)")
    text = f"trim(regexp_replace({text}, {_sql(r'^' + chr(92) + 'n|' + chr(92) + 'n$')}, '', 'g'), ' ')"
    crlf = "chr(13) || chr(10)"

    def urn(*parts: str) -> str:
        joined = "md5(concat_ws(chr(31), " + ", ".join(parts) + "))"
        return f"(select '<urn:uuid:' || h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] || '>' from (select {joined} as h))"

    head = f"'HTTP/1.1 200 OK' || {crlf} || 'http-header: Content-Type: text/html; charset=utf-8' || {crlf} || 'http-header: Content-Length: ' || strlen(html)"
    return f"""
      with p as (select page_id, url, coalesce(html, '') as html, {bare.replace("html", "coalesce(html, '')", 1)} as bare from pages),
      q as (select *, {text} as txt, 'sha256:' || sha256(html) as source_digest,
              {urn("'response'", "coalesce(page_id::varchar, '')", "coalesce(url, '')")} as refers_to,
              trim(regexp_replace({title}, '\\s+', ' ', 'g'), ' ') as title,
              regexp_extract(bare, '(?i)<html\\b[^<>]*?\\blang=["'']?([A-Za-z-]+)', 1) as language,
              len(regexp_extract_all(bare, '(?i)<a\\b[^<>]*\\bhref=')) as links from p),
      r as (select *, {urn("'conversion'", "refers_to")} as conversion_id, {urn("'metadata'", "refers_to")} as metadata_id,
              'source-payload-digest: ' || source_digest || {crlf} || 'http-status-line: ' || {head} || {crlf} || 'title: ' || title || {crlf}
              || 'language: ' || language || {crlf} || 'outlinks: ' || links || {crlf} || 'text-length: ' || strlen(txt) || {crlf} as fields from q),
      s as (select page_id, 'metadata' as record_type, metadata_id as record_id, refers_to, conversion_id as concurrent_to, url, source_digest,
              'application/warc-fields' as content_type, fields as block from r
            union all select page_id, 'conversion', conversion_id, refers_to, null, url, source_digest, 'text/plain; charset=utf-8', txt from r)
      select page_id, record_type, record_id, refers_to, concurrent_to, url as target_uri, '2024-01-01T00:00:00Z' as date, content_type, source_digest,
        'sha256:' || sha256(block) as block_digest, strlen(block)::bigint as content_length, block from s"""


ORACLE["op7_warc_derivatives"] = _warc_sql()


def _merkle_sql(levels: int = 8, tops: int = 4) -> str:
    """Trees of up to 8 ** ``levels`` rows, of up to 8 ** ``tops`` groups, level by level."""
    value = "coalesce(strlen({0}::varchar) || ':' || {0}::varchar, '-')"
    leaf = lambda text: "sha256(" + " || ".join(value.format(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    byte = "list_reduce([xor(crc, one)] || [0, 0, 0, 0, 0, 0, 0, 0]::bigint[], lambda c, _: xor(c >> 1, 3988292384 * (c & 1)))"
    crc = f"xor(list_reduce([4294967295] || list_transform(string_split(doc_id::varchar, ''), lambda s: ascii(s)::bigint), lambda crc, one: {byte}), 4294967295)"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [
        f"d as (select doc_id, lang, {leaf('text')} as h, case when {crc} % 3 = 0 then {leaf(lower)} else {leaf('text')} end as now from documents)",
        "l0 as (select *, row_number() over (partition by lang order by doc_id nulls first, h) - 1 as place, count(*) over (partition by lang) as n from d)",
        f"t0 as (select lang, h, row_number() over (order by lang nulls first) - 1 as place, count(*) over () as n from l{levels})",
    ]

    def level(own: str, k: int, group: str) -> list[str]:
        run = f"over (partition by {group} place // 8 order by place rows between"
        return [
            f"{own}s{k} as (select *, coalesce(string_agg(h, '') {run} unbounded preceding and 1 preceding), '') as b, "
            f"coalesce(string_agg(h, '') {run} 1 following and unbounded following), '') as a from {own}{k})",
            f"{own}{k + 1} as (select {group} place // 8 as place, (n + 7) // 8 as n, case when n = 1 then any_value(h) else sha256(string_agg(h, '' order by place)) end as h "
            f"from {own}{k} group by {group} place // 8, n)",
        ]

    for k in range(levels):
        parts += level("l", k, "lang,")
    for k in range(tops):
        parts += level("t", k, "")
    steps = [(f"ls{k}", f"on ls{k}.lang is not distinct from l0.lang and ls{k}.place = l0.place // {8**k}") for k in range(levels)]
    steps += [(f"ts{k}", f"on ts{k}.place = t0.place // {8**k}") for k in range(tops)]
    joins = " ".join(f"join {name} {on}" for name, on in steps[:levels])
    joins += " join t0 on t0.lang is not distinct from l0.lang " + " ".join(f"join {name} {on}" for name, on in steps[levels:])
    columns = []
    for i, (name, _) in enumerate(steps):
        columns.append(f"{name}.n as n{i}, {name}.b as b{i}, {name}.a as a{i}")
    proof = " || ".join(f"b{i} || a{i}" for i in range(len(steps)))
    folds = []
    for i in range(len(steps)):
        before = "now" if i == 0 else f"f{i - 1}"
        source = "j" if i == 0 else f"g{i - 1}"
        folds.append(f"g{i} as (select *, case when n{i} = 1 then {before} else sha256(b{i} || {before} || a{i}) end as f{i} from {source})")
    last = len(steps) - 1
    ordered = parts[:2] + parts[3 : 3 + 2 * levels] + [parts[2]] + parts[3 + 2 * levels :]
    chosen = f"j as (select l0.doc_id, l0.now, l0.h as leaf, t0.h as subroot, t{tops}.h as root, {', '.join(columns)} from l0 {joins} cross join t{tops})"
    return (
        "with " + ",\n".join([*ordered, chosen, *folds])
        + f"\nselect doc_id, leaf, subroot, root, sha256({proof}) as proof_sha256, f{last} as folded_root, f{last} = root as verified from g{last}"
    )


ORACLE["op12_merkle_manifest"] = _merkle_sql()

"""Secret scans: long, digit-bearing or assigned strings are candidates; a random forest removes the false ones.

The forest sees a candidate's length, its changes of character class, how much of it dictionary words cover, the path of its
document and the words beside it.  It learns from labelled findings, a bounded number of them.  DataFrame functions and
``pyspark.ml`` only; no Python runs in tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm import pii
from folioflow.session import materialise

#: Names of credentials; lookbehinds are of one width each, so that any expression engine takes them.
_NAMES = ("token", "secret", "passwd", "apikey", "api_key", "api-key", "password", "credential", "privatekey", "private_key")


def _after_name(end: str = "") -> str:
    """Behind a credential's name, perhaps quoted, a sign of assignment with a space or none on either side, and ``end``."""
    same = ["|".join(n for n in _NAMES if len(n) == size) for size in sorted({len(n) for n in _NAMES})]
    forms = [rf"{q}{s}[=:]{t}{end}" for q in ("", r"[\x22']") for s in ("", r"\x20") for t in ("", r"\x20")]
    return "(?:" + "|".join(rf"(?<=(?i:{names}){form})" for names in same for form in forms) + ")"


def _quoted(sign: str, rule: str) -> str:
    """What lies between two quotes of one kind, the other kind and escaped signs included; ``rule`` stands for its length."""
    pairs = ((r"\x22", "'"), ("'", r"\x22"))
    return "(?:" + "|".join(rf"(?<={q})" + rule.format(sign=rf"(?:[{sign.format(q=q, other=other)}]|\\[^\r\n])", q=q) + rf"(?={q})" for q, other in pairs) + ")"


_SIGN = "[A-Za-z0-9+/_-]"
_ENOUGH = r"(?:(?=[^\s0-9{q}]*+[0-9]){sign}{{12,}}+|{sign}{{20,}}+)"
#: An unquoted value ends at white space, a quote or the next ``name=``; closing signs at its end are not its own.
_OPEN = r"(?:[^\s\x22'&,;)\]}]|(?![&,;][A-Za-z0-9_]{1,64}+[=:])[&,;)\]}](?![&,;)\]}]{0,8}+(?:[\s\x22']|\Z)))"
_PLAIN = r"[!#-%(*+\--:<>-\\^-|~]"
#: Candidates, the whole value each, the wider ones first: what is assigned to a credential's name, in quotes (with spaces) or
#: not, from 8 signs; what is assigned in quotes without spaces, from 8; what else stands in quotes or is assigned without, and
#: at last any run of ``_SIGN``, of 12 signs with a digit among them or 20 of any kind.  None has a greatest length.
CANDIDATE = "|".join((
    rf"(?<=[\x22']){_after_name(r'[\x22' + chr(39) + ']')}" + _quoted(r"^{q}\\\r\n", "{sign}{{8,}}+"),
    r"(?<=[=:]\x20?[\x22'])" + _quoted(r"^{q}\\\s", "{sign}{{8,}}+"),
    r"(?<=[\x22'])" + _quoted(r"!#-&(-\[\]-~{other}", _ENOUGH),
    rf"(?:(?<=[=:])|(?<=[=:]\x20))(?![\x22'\s]){_after_name()}{_OPEN}{{8,}}+",
    rf"(?:(?<==)|(?<=[=:]\x20)){_ENOUGH.format(sign=_PLAIN, q=chr(92) + 'x22' + chr(39) + '&,;)=' + chr(92) + ']}')}(?:={{1,2}}+(?![A-Za-z0-9\x22'=]))?+",
    rf"(?<![A-Za-z0-9+/_-])(?:(?=[A-Za-z+/_-]*+[0-9]){_SIGN}{{12,}}+|{_SIGN}{{20,}}+)",
))
#: Code points on either side that are looked at.
NEAR = 60
#: Labelled findings a forest learns from at most: those least by hash.
LABELLED = 20_000
#: A word is in the dictionary if this share of the documents has it; D distinct words a document bound it to D / SHARE words.
SHARE = 0.002
#: Letters of a dictionary word at least; there is no greatest length.
WORD = 3
#: Places of a value that are looked at together.
PIECE = 256
BUCKETS = 16
TREES, DEPTH, SEED = 24, 6, 7

#: Forms that are keys wherever they stand (fixed values): access key ids, tokens with a provider's prefix, signed tokens.
KNOWN = (
    r"(?:AKIA|ASIA)[A-Z0-9]{16}",
    r"gh[pousr]_[A-Za-z0-9]{36,}",
    r"xox[abprs]-[A-Za-z0-9-]{10,}",
    r"(?:sk|pk|rk)_(?:live|test)_[A-Za-z0-9]{16,}",
    r"AIza[A-Za-z0-9_-]{35}",
    r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*",
)
_CREDENTIAL = r"(?:token|secret|passw(?:or)?d|api[_-]?key|private_?key|credential)[\x22']?\s*[=:]\s*[\x22']?$"


def findings(docs: DataFrame, text: str = "text", path: str = "source") -> DataFrame:
    """``doc_id``, ``path``, ``start`` (code point), ``value``, ``before`` and ``after`` of every candidate.

    NULL and empty texts have none; repeated documents give theirs each.  One pass, no shuffle.
    """
    content = F.coalesce(F.col("__text"), F.lit(""))
    given = docs.select("doc_id", F.col(path).cast("string").alias("path"), F.col(text).alias("__text"))
    gaps, matches = F.split(content, CANDIDATE, -1), F.regexp_extract_all(content, F.lit(CANDIDATE), F.lit(0))
    given = given.withColumn("__gaps", gaps).where(F.size("__gaps") > 1)

    def piece(m: Column, i: Column) -> Column:
        before, after = F.get(F.col("__gaps"), i), F.get(F.col("__gaps"), i + 1)
        near = F.concat(F.right(before, F.lit(NEAR)), F.lit("\x01"), F.left(after, F.lit(NEAR)))
        return F.struct(F.length(before).cast("long").alias("gap"), F.length(m).cast("long").alias("size"), m.alias("match"), near.alias("near"))

    given = given.withColumn("__pieces", F.transform(matches, piece))
    starts, spans = pii.positions(F.col("__pieces"))
    found = given.withColumn("__starts", starts).select("doc_id", "path", F.explode(spans).alias("s"))
    return found.select(
        "doc_id",
        "path",
        F.col("s.start").alias("start"),
        F.col("s.match").alias("value"),
        F.substring_index("s.near", "\x01", 1).alias("before"),
        F.substring_index("s.near", "\x01", -1).alias("after"),
    )


def weak_label(before: Column, value: Column) -> Column:
    """Label of a finding by rule, for corpora without reviewed ones, and NULL for what the rule cannot judge.

    1: assigned to a credential's name with a digit in it, or of a form that is ``KNOWN``.  0: letters alone, words of letters
    joined by one kind of sign, or digits alone, and not assigned to such a name.
    """
    assigned = F.lower(before).rlike(_CREDENTIAL)
    known = value.rlike("^(?:" + "|".join(KNOWN) + ")$")
    prose = value.rlike(r"^\p{L}+(?:(?:_\p{L}+)*|(?:-\p{L}+)*|(?:/\p{L}+)*)$|^[0-9]+$")
    return F.when(known | (assigned & value.rlike("[0-9]")), 1.0).when(prose & ~assigned, 0.0)


def dictionary(docs: DataFrame, text: str = "text", share: float = SHARE) -> DataFrame:
    """``word``: lower-case words of ``WORD`` letters or more that at least ``share`` of the documents have; counted over all of them."""
    letters = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"\p{L}{%d,}+" % WORD), F.lit(0))
    words = docs.select(F.explode(F.array_distinct(letters)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return words.where(F.col("n") >= docs.count() * share).select("word")


def coverage(found: DataFrame, words: DataFrame) -> DataFrame:
    """``__key`` (digest of the value), ``covered``: the share of each distinct value's signs that lie in a dictionary word.

    Only digests go with the parts of a value, and parts are taken from pieces of ``PIECE`` places, so that a long value
    costs no more than its length.  Parts have the lengths that words of the dictionary have: a handful of numbers, at
    the driver, that do not grow with the corpus.
    """
    lengths = sorted(r["n"] for r in words.select(F.length("word").alias("n")).distinct().collect()) or [WORD]
    values = found.select(F.sha2("value", 256).alias("__key"), "value").dropDuplicates(["__key"])
    size, most = F.length("value"), lengths[-1]
    pieces = values.select("__key", "value", size.alias("size"), F.explode(F.sequence(F.lit(0), F.floor((size - 1) / PIECE).cast("int"))).alias("p"))
    pieces = pieces.where("size > 0").select("__key", "size", (F.col("p") * PIECE).alias("p"), F.col("value").substr(F.col("p") * PIECE + 1, F.lit(PIECE + most - 1)).alias("piece"))
    long = F.length("piece")
    at = pieces.where(long >= lengths[0]).select("__key", "size", "p", "piece", F.explode(F.sequence(F.lit(1), F.least(F.lit(PIECE), long - lengths[0] + 1))).alias("at"))
    part = at.select("__key", "size", "p", "piece", "at", F.explode(F.array(*map(F.lit, lengths))).alias("n")).where(F.col("n") <= F.length("piece") - F.col("at") + 1)
    part = part.select("__key", "size", (F.col("p") + F.col("at")).alias("at"), "n", F.lower(F.col("piece").substr(F.col("at"), F.col("n"))).alias("word"))
    met = part.join(words, "word").groupBy("__key", "size", "at").agg(F.max("n").alias("n"))
    signs = met.select("__key", "size", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("n") - 1)).alias("sign")).distinct()
    return signs.groupBy("__key").agg((F.count(F.lit(1)) / F.first("size")).alias("covered"))


def _bucket(word: Column) -> list[Column]:
    number = F.pmod(F.xxhash64(word), F.lit(BUCKETS))
    return [(number == b).cast("double") for b in range(BUCKETS)]


def described(found: DataFrame, words: DataFrame) -> DataFrame:
    """``found`` with ``covered``, ``transitions`` (share of neighbouring signs of different class) and the vector ``features``."""
    rows = found.drop("covered").withColumn("__key", F.sha2("value", 256)).join(coverage(found, words), "__key", "left").drop("__key")
    rows = rows.withColumn("covered", F.coalesce("covered", F.lit(0.0)))
    value, size = F.col("value"), F.length("value")
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[a-z]+", "a"), "[A-Z]+", "b"), "[0-9]+", "0")
    rows = rows.withColumn("transitions", (F.length(F.regexp_replace(classes, "[^ab0]+", "-")) - 1) / F.greatest(size - 1, F.lit(1)))
    previous = F.regexp_extract(F.lower("before"), r"(\p{L}+)[^\p{L}]*$", 1)
    following = F.regexp_extract(F.lower("after"), r"^[^\p{L}]*(\p{L}+)", 1)
    numbers = [
        size.cast("double"),
        F.col("transitions"),
        F.col("covered"),
        F.length(F.regexp_replace(value, "[^0-9]", "")) / size,
        F.size(F.array_distinct(F.split(value, ""))) / size,
        F.col("before").rlike(r"[\x22']$").cast("double"),
        F.col("before").rlike(r"[=:]\s*[\x22']?$").cast("double"),
        *_bucket(F.coalesce("path", F.lit(""))),
        *_bucket(previous),
        *_bucket(following),
    ]
    return rows.withColumn("features", array_to_vector(F.array(*numbers)))


@dataclass
class Forest:
    """A fitted model, or the one label all findings had (0 where there were none)."""

    model: RandomForestClassificationModel | None
    constant: float = 0.0

    def score(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``probability`` that the finding is a secret."""
        if self.model is None:
            return rows.withColumn("probability", F.lit(self.constant))
        scored = self.model.transform(rows.drop("rawPrediction", "probability", "prediction"))
        return scored.withColumn("probability", vector_to_array("probability")[1]).drop("rawPrediction", "prediction")


def fit(rows: DataFrame, label: str = "label", most: int = LABELLED) -> Forest:
    """Forest of the labelled rows (``features``, ``label`` 0 or 1; others teach nothing), of the ``most`` least by hash."""
    order = F.xxhash64("value", "before", "after", "doc_id", "start")
    known = rows.where(F.col(label).isin(0.0, 1.0)).select("features", F.col(label).alias("label"), order.alias("o"))
    sample = materialise(known.orderBy("o").limit(most).select("features", "label"), "labelled")
    kinds = sorted(r["label"] for r in sample.select("label").distinct().collect())
    if len(kinds) < 2:
        return Forest(None, kinds[0] if kinds else 0.0)
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="onethird")
    return Forest(forest.fit(sample))

"""Secret scanning with a random forest that removes false positives. DataFrame functions and JVM learning only.

A candidate is a word (between ASCII white space) that assigns a value to a key-like name, that holds a run
of at least 12 letters, digits and _+/=.@- with a digit, a run of at least 16 whose letters change case four times
or a fixed-prefix key, or that is a value of 6 or more characters whose key-like name and assignment sign stand in
the words before it ("password: x", "token = x"). What such words often are (addresses, card numbers, dates,
versions, digests, identifiers) makes most of them false; the forest separates them by

- length of the run,
- transitions between neighbouring characters: letter to digit and back, lower to upper case and back,
- shares of digits, capitals, hexadecimal digits and vowels, and how many characters differ,
- dictionary coverage: the share of the run that words of the corpus make up, those in at least min_share of all
  texts, kept as a bitmap of fixed size; and the share of placeholders,
- path: whether it names tests, examples or documentation, or code and settings,
- neighbouring words: key-like names, an assignment sign, quotes, or words for harmless codes.

It is trained from labelled findings. A caller may pass its own (columns of candidates() and
label); else verified formats in the corpus itself label them: fixed-prefix keys and values assigned to a
credential name that are quoted, long with a digit, or mix letters with digits are secrets; addresses, links, pure
numbers, dates, names joined of words and digests after a word for one are not, and neither are long words of
prose, of which hashes choose some in about max_prose texts. Rows whose format decides nothing are not learned
from. So that the forest does more than repeat these rules, each finding is also learned from without its
names (long ones of the secrets): what a secret looks like then decides where no name stands. Fitting takes at most
about max_findings findings per label, chosen by a hash.

Defined results: null and empty texts have no candidates; a null id is an id like any other; repeated rows
give repeated findings; a word that occurs several times in a text is a finding each time; where the corpus has
not both labels there is no forest, and a candidate's score is what its format says, 0.5 (a secret, as nothing
speaks against it) where that decides nothing; an empty table gives an empty result. Only the named columns are
read; redact() returns the others as they are, and masks equal texts alike.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maploom.llm.shared import written

SPACE = r"[\x20\x09-\x0D]+"
NAME = r"(?i)(pass(word|wd|phrase)?|pwd|secret|token|credential|api[_-]?key|access[_-]?key|auth)"
ASSIGNED = NAME + r"[\w-]{0,30}[\x22']?[:=]{1,2}[\x22']?[^\s\x22']{6,}"
RUN = r"[A-Za-z0-9_+/=.@-]{12,}"
# tried at the beginning of a run alone, so that a long run is read once
NUMBERED_RUN = r"(?<![A-Za-z0-9_+/=.@-])(?=[A-Za-z_+/=.@-]*[0-9])" + RUN
#: Beginnings of keys that services hand out.
PREFIXED = r"\b(AKIA|ASIA)[A-Z0-9]{16}\b|\bgh[pousr]_[A-Za-z0-9]{20,}|\bgithub_pat_\w{22,}|\bglpat-[\w-]{20}|\bxox[abprs]-[\w-]{10,}|\bAIza[\w-]{35}|\bsk_(live|test)_\w{16,}|\bSG\.[\w-]{16,}\.[\w-]{16,}|\beyJ[\w-]{10,}\.[\w-]{10,}\.[\w-]{10,}"
# four groups of small letters, parted by capitals and digits
MIXED_RUN = r"(?<![A-Za-z0-9_+/=.@-])(?=(?:[A-Z0-9]*+[a-z]++){4})[A-Za-z0-9_+/=.@-]{16,}"
CANDIDATE = f"({ASSIGNED})|({NUMBERED_RUN})|({PREFIXED})|({MIXED_RUN})"
# a value apart from its name: "name: value", "name = value", "name =value"; in the last of words joined by spaces, and in texts
VALUE = r"[\x22'(\[]*[^\s\x22']{6,}"
NAMED_VALUE = NAME + r"[\w-]{0,30}[\x22']?(?: ?[:=]{1,2}>? | [:=]{1,2}>?)" + VALUE + r"\S*$"
NAMED_IN_TEXT = NAME + rf"[\w-]{{0,30}}[\x22']?(?:(?:{SPACE})?[:=]{{1,2}}>?{SPACE}|{SPACE}[:=]{{1,2}}>?)" + VALUE
HARMLESS = r"^\W*([\w.+-]+@[\w-]+(\.[\w-]+)+|https?://\S+|[+(]?[0-9][0-9().,:/-]*|[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9:.]+Z?)\W*$"
DIGEST = r"^[^0-9a-zA-Z]*([0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64})[^0-9a-zA-Z]*$"
# words and short numbers, joined by signs or by capitals
IDENTIFIER = r"^\W*([A-Za-z]{2,}([._-]([A-Za-z]{2,}|v?[0-9]{1,10}))+|[A-Z]?[a-z]{2,}([A-Z][a-z]{2,}){2,}[0-9]{0,4})\W*$"
#: Bits of the bitmap that stands for the dictionary.
DICTIONARY = 1 << 21
#: What is no secret even after a credential name.
ADDRESS = r"^\W*([\w.+-]+@[\w-]+(\.[\w-]+)+|https?://\S+|[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9:.]+Z?)\W*$"
#: Words that make a code a placeholder or an ordinary name.
COMMON = "(?i)(example|sample|dummy|placeholder|changeme|change|default|password|passwd|secret|token|test|demo|your|insert|here|user|admin|login|name|mail|http|https|www|com|org|net|html|the|and|ing|tion|ment|version|release|build|data|file|image|page|index|config|null|none|true|false|foo|bar|baz|qwerty|abc|xxx+|000+|1234+)"
HARMLESS_WORDS = r"(?i)(sha\d*|md5|commit|checksum|digest|hash|uuid|guid|isbn|doi|version|build|example|sample|card|phone|tel|call|order|invoice|serial|tracking|from|at)\W*$"
CODE_PATH = r"(?i)(\.(py|js|ts|java|go|rb|sh|ya?ml|json|toml|cfg|conf|ini|env|properties)$|config|settings|code|repo|git)"
TEST_PATH = r"(?i)(test|spec|mock|fixture|example|sample|doc|readme|demo)"
FEATURES = ["length", "letter_digit", "case_turns", "digits", "capitals", "hexes", "vowels", "distinct", "coverage", "placeholders", "dots", "at_sign", "test_path", "code_path", "named_within", "named_before", "assigned_before", "quoted", "harmless_before", "harmless_after"]


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", pattern: str = CANDIDATE, named: bool = True) -> DataFrame:
    """(id, place, word, before2, before1, after1, path, text_hash) of each word that matches pattern, or with named is
    a value that the words before it name; place counts words from 0."""
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col else F.lit("")
    # texts without any match are dropped before they are split
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), path.alias("path")).where(F.col("text").rlike(f"({pattern})|({NAMED_IN_TEXT})" if named else pattern))
    words = rows.select("id", "path", F.xxhash64("text").alias("text_hash"), F.split(F.regexp_replace("text", f"^{SPACE}|{SPACE}$", ""), SPACE).alias("w"))
    before = lambda i, d: F.coalesce(F.get("w", i - d), F.lit(""))
    signed = lambda x, i: F.substring(before(i, 1), -1, 1).isin(":", "=", ">") | F.substring(x, 1, 1).isin(":", "=")
    after_name = lambda x, i: signed(x, i) & F.concat_ws(" ", before(i, 2), before(i, 1), x).rlike(NAMED_VALUE)
    hit = lambda x, i: x.rlike(pattern) | after_name(x, i) if named else x.rlike(pattern)
    at = F.filter(F.transform("w", lambda x, i: F.when(hit(x, i), i)), lambda i: i.isNotNull())
    found = words.withColumn("place", F.explode(at))
    near = lambda d: F.coalesce(F.get("w", F.col("place") + d), F.lit(""))
    return found.select("id", "place", near(0).alias("word"), near(-2).alias("before2"), near(-1).alias("before1"), near(1).alias("after1"), "path", "text_hash")


def _named() -> Column:
    return F.concat_ws(" ", "before2", "before1", "word").rlike(NAMED_VALUE)


def _run(word: Column) -> Column:
    """The value in a word: what follows an assignment sign or a name before the word, else the longest part of its characters."""
    quoted = F.regexp_extract(word, r"^[:=>(\[]*[\x22']([^\x22']{6,})[\x22']", 1)
    apart = F.when(quoted != "", quoted).otherwise(F.regexp_replace(word, r"^[:=>(\[\x22']+|[\x22'),;.\]]+$", ""))
    value = F.regexp_extract(word, r"[:=]{1,2}[\x22']?([^\s\x22']{6,})", 1)
    return F.when((value != "") & word.rlike(ASSIGNED), value).when(_named(), apart).otherwise(F.regexp_replace(word, r"^[^A-Za-z0-9]+|[^A-Za-z0-9=]+$", ""))


def _parts(run: Column) -> Column:
    """The words that a run is made of, in small letters."""
    return F.transform(F.regexp_extract_all(run, F.lit(r"[A-Z]?[a-z]{2,}|[A-Z]{3,}"), F.lit(0)), F.lower)


def _bit(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(DICTIONARY))


def dictionary(docs: DataFrame, text_col: str = "text", min_share: float = 1e-4, min_texts: int = 3) -> DataFrame:
    """One row: a bitmap (bits) of the words of at least min_texts texts and of at least min_share of them all.

    Tasks count the words of their texts before these meet. The bitmap's size does not grow with the corpus.
    """
    words = docs.select(F.explode(F.array_distinct(_parts(F.col(text_col)))).alias("w")).where(F.length("w") > 2)
    common = words.groupBy("w").count().where(F.col("count") >= max(min_texts, int(min_share * docs.count())))
    spans = F.sequence(F.lit(1), F.lit(DICTIONARY // 32768))
    maps = common.select(_bit(F.col("w")).alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    empty = F.unhex(F.lit("00" * 4096))
    listed = maps.agg(F.map_from_entries(F.collect_list(F.struct("bucket", "bits"))).alias("m"))  # a row for each of at most 65 buckets
    return listed.select(F.aggregate(spans, F.unhex(F.lit("")), lambda acc, k: F.concat(acc, F.coalesce(F.try_element_at("m", k.cast("long")), empty))).alias("bits"))


def _known(bits: Column, word: Column) -> Column:
    """Whether bits has the word."""
    # buckets count from 1 and hold 32768 bits each
    at = _bit(word)
    place = F.bitmap_bit_position(at) + (F.bitmap_bucket_number(at) - 1) * 32768
    byte = F.conv(F.hex(F.substring(bits, (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.call_function("shiftright", byte, place.bitwiseAND(F.lit(7)).cast("int")).bitwiseAND(F.lit(1)) == 1


def with_features(found: DataFrame, bits: Column | None = None) -> DataFrame:
    """found with the value (run) in each word and FEATURES; bits: the bitmap of dictionary()."""
    count = lambda text, pattern: F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).cast("double")
    flag = lambda c: c.cast("double")
    rows = found.withColumn("run", _run(F.col("word"))).withColumn("_bits", F.lit(b"") if bits is None else bits)
    n = F.greatest(F.length("run"), F.lit(1)).cast("double")
    run = F.col("run")
    return rows.withColumns(
        {
            "length": n,
            "letter_digit": count(run, r"(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])") / n,
            "case_turns": count(run, r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])") / n,
            "digits": count(run, "[0-9]") / n,
            "capitals": count(run, "[A-Z]") / n,
            "hexes": count(run, "[0-9a-fA-F]") / n,
            "vowels": count(run, "[aeiouAEIOU]") / n,
            "distinct": F.size(F.array_distinct(F.split(run, ""))).cast("double") / n,
            "coverage": F.lit(0.0) if bits is None else F.aggregate(F.filter(_parts(run), lambda w: _known(F.col("_bits"), w)), F.lit(0.0), lambda acc, w: acc + F.length(w)) / n,
            "placeholders": 1 - F.length(F.regexp_replace(run, COMMON, "")) / n,
            "dots": count(run, "[.]") / n,
            "at_sign": flag(F.contains(run, F.lit("@"))),
            "test_path": flag(F.col("path").rlike(TEST_PATH)),
            "code_path": flag(F.col("path").rlike(CODE_PATH)),
            "named_within": flag(F.col("word").rlike(ASSIGNED)),
            "named_before": flag(F.concat_ws(" ", "before2", "before1").rlike(NAME + r"[\w-]*[\x22']?( ?[:=]+)?$") | _named()),
            "assigned_before": flag(F.col("before1").rlike(r"[:=]$")),
            "quoted": flag(F.col("word").rlike(r"^[^\w]*[\x22'].*[\x22'][^\w]*$")),
            "harmless_before": flag(F.col("before1").rlike(HARMLESS_WORDS)),
            "harmless_after": flag(F.col("after1").rlike(HARMLESS_WORDS)),
        }
    ).drop("_bits")


def _label() -> Column:
    """What the format of a finding says: 1 for a secret, 0 for none, null where it decides nothing."""
    word = F.col("word")
    value = word.rlike(r"^\W*[\x22'][^\x22']{6,}[\x22']") | word.rlike(NUMBERED_RUN) | word.rlike(r"(?=\S*[A-Za-z])\S*[0-9]")
    secret = (_named() & value) | (word.rlike(ASSIGNED) & word.rlike(NUMBERED_RUN))
    prose = word.rlike(r"^\p{L}+[.,;:]?$")
    harmless = word.rlike(HARMLESS) | word.rlike(IDENTIFIER) | prose | (word.rlike(DIGEST) & F.col("before1").rlike(HARMLESS_WORDS))
    return F.when(word.rlike(PREFIXED), 1.0).when(harmless & ~word.rlike(ASSIGNED) & ~(_named() & ~word.rlike(ADDRESS)), 0.0).when(secret, 1.0)


def labelled(found: DataFrame) -> DataFrame:
    """The findings whose format tells what they are; label 1 for secrets."""
    return found.withColumn("label", _label()).where("label IS NOT NULL")


def fit_forest(findings: DataFrame, bits: Column | None = None, max_findings: int = 5000, trees: int = 30, depth: int = 6) -> PipelineModel | None:
    """A forest over labelled findings (columns of candidates() and label), or None while a label is missing."""
    counts = {r["label"]: r["n"] for r in findings.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts.get(0.0) or not counts.get(1.0):
        return None
    place = F.pmod(F.xxhash64("word", "before1", "id", "place"), F.lit(1 << 30))
    limit = F.lit(0)
    for label, n in counts.items():
        limit = F.when(F.col("label") == label, F.lit(int((1 << 30) * min(1.0, max_findings / n)))).otherwise(limit)
    sample = with_features(findings.where(place < limit), bits).select("label", *FEATURES)
    nameless = sample.where("label = 0 OR length >= 16").withColumns({c: F.lit(0.0) for c in ("named_within", "named_before", "assigned_before")})
    # in one order, whatever the partitions: the same forest each time
    learned = written(sample.unionByName(nameless)).orderBy(*FEATURES, "label").coalesce(1)
    steps = VectorAssembler(inputCols=FEATURES, outputCol="features")
    forest = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=trees, maxDepth=depth, seed=7)
    return PipelineModel([steps, forest.fit(steps.transform(learned))])


def _scored(docs: DataFrame, id_col: str, text_col: str, path_col: str | None, findings: DataFrame | None, threshold: float, max_prose: int) -> DataFrame:
    found, bits = written(candidates(docs, id_col, text_col, path_col)), written(dictionary(docs, text_col)).scalar()
    if findings is None:
        some = docs.where(F.pmod(F.xxhash64(F.col(id_col), F.col(text_col), F.lit("prose")), F.lit(1 << 30)) < int((1 << 30) * min(1.0, max_prose / max(docs.count(), 1))))
        prose = candidates(some, id_col, text_col, path_col, r"\p{L}{12,}", named=False).where(F.pmod(F.xxhash64("word", F.lit("prose")), F.lit(64)) == 0)
        findings = labelled(found.unionByName(prose))
    model = fit_forest(written(findings), bits)
    rows = with_features(found, bits)
    if model is None:
        rows = rows.withColumn("score", F.coalesce(_label(), F.lit(0.5)))
    else:
        rows = model.transform(rows).withColumn("score", F.round(vector_to_array("probability")[1], 6))
    return rows.withColumn("is_secret", F.col("score") >= threshold)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", findings: DataFrame | None = None, threshold: float = 0.5, max_prose: int = 2000) -> DataFrame:
    """Each candidate with its score and whether it is a secret: id, place, word, value, score, is_secret."""
    rows = _scored(docs, id_col, text_col, path_col, findings, threshold, max_prose)
    return rows.select(F.col("id").alias(id_col), "place", "word", F.col("run").alias("value"), "score", "is_secret")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", mask: str = "[SECRET]", salts: int = 16) -> DataFrame:
    """docs with every secret's value replaced in its text, wherever it occurs there.

    Values go back by a hash of the text, not by id. Their table has a row for each text with secrets and salt, so
    that the copies of a text are dealt over salts, whatever salt a row draws.
    """
    secret = _scored(docs, id_col, text_col, path_col, None, 0.5, 2000).where("is_secret AND run <> ''")
    values = secret.groupBy(F.col("text_hash").alias("_hash")).agg(F.collect_set("run").alias("_values"))
    values = values.withColumn("_values", F.array_sort("_values", lambda a, b: F.length(b) - F.length(a))).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = docs.select(F.struct("*").alias("_row"), F.xxhash64(F.col(text_col)).alias("_hash"), F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int").alias("_salt"))
    joined = rows.join(values, ["_hash", "_salt"], "left")
    text = F.col("_row").getField(text_col)
    clean = F.when(F.col("_values").isNull(), text).otherwise(F.aggregate("_values", text, lambda t, v: F.replace(t, v, F.lit(mask))))
    return joined.select(*((clean if c == text_col else F.col("_row").getField(c)).alias(c) for c in docs.columns))


def op3_secrets(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Secret scans: patterns find candidates, a random forest removes the false ones (native: DataFrame functions only).

A candidate is a token of 16 characters or more after any delimiter, a value of any length assigned to a name with a
word such as ``token`` or ``password`` in it, the password of a URL, a whole JSON web token, or the head of a private
key. Long tokens inside a candidate (between slashes, or in an assigned URL) are candidates too. The forest judges it by its length, its character classes and the transitions between them, how much
of it words of a dictionary cover, the path of its document, and the words before and after it. It is trained by
Spark ML on labelled findings (``labelled_findings``), and applied as a DataFrame transformation.

Texts are cut at the candidates by the same pattern that extracts them, so each candidate's neighbours and position
follow from the pieces between: the work is linear in the text.

Defined cases: a null text has no candidates; a null path is the empty path; null ids stay null; every occurrence is
a row of its own, in repeated rows too; an empty table gives an empty result; further columns take no part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.pipeline import Pipeline
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

# The patterns of candidates, of assigned names, and of tell-tale neighbours and paths.
NAMES = r"(?:api[_-]?key|access[_-]?key|private[_-]?key|authorization|auth|bearer|credential|passphrase|passwd|password|pwd|secret|token|(?<=[_-])(?:key|pass|pat|psk|pw))"
KEY_HEAD = r"-----BEGIN [A-Z ]*PRIVATE KEY-----"
#: A name holds one of the words whole: before its end, a non-letter, a plural s, or the next part of a camelCase name.
NAME = rf"(?<![A-Za-z0-9+/_.-])(?=[A-Za-z0-9+/_.-]*?(?i:{NAMES})(?:s?(?![A-Za-z])|(?<=[a-z])(?=[A-Z])))[A-Za-z0-9+/_.-]++"
LEAD = rf"{NAME}[\"']?\s{{0,3}}[:=]{{1,2}}+>?\s{{0,3}}[\"']?(?i:(?:bearer|basic|token)\s{{1,3}})?"
ASSIGNED = rf"{LEAD}[^\s\"',;]++"
#: User and password of a URL.
LOGIN = r"(?<=:)//[^\s/:@\"'<>]*+:[^\s/:@\"'<>]++(?=@)"
JWT_PARTS = r"eyJ[A-Za-z0-9_-]++(?:\.[A-Za-z0-9_-]*+){2,4}"
JWT = rf"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]*?[+/])?{JWT_PARTS}"
TOKEN = r"(?<![A-Za-z0-9+/_-])(?=[+/_-]*[A-Za-z0-9])[A-Za-z0-9+/_-]{16,}+={0,2}"
CANDIDATE = rf"{KEY_HEAD}|{LOGIN}|{JWT}|{ASSIGNED}|{TOKEN}"
#: Long tokens inside a candidate: between slashes, and in names and values of an assignment.
INNER = r"(?<![A-Za-z0-9+_-])(?=[+_-]*[A-Za-z0-9])[A-Za-z0-9+_-]{16,}+={0,2}"
SECRET_WORDS = rf"(?i){NAMES}"
HARMLESS_WORDS = r"(?i)(checksum|commit|digest|example|hash|isbn|md5|order|phone|placeholder|revision|sample|serial|sha1|sha256|tracking|uuid|version|integrity|etag|card|number)"
HARMLESS_PATHS = r"(?i)(doc|example|fixture|lock|mock|readme|sample|test|vendor)"
#: Values that stand for a secret without being one.
REFERENCE = r"(?i)^(?:[$<{%*(\[].*|https?:.*|.*[({\[].*|.*env\..*|null|none|nil|true|false|yes|no|required|optional|string|undefined)$"
COMMON_PAIRS = r"(?i)(?=(th|he|in|er|an|re|on|at|en|nd|ti|es|or|te|ed|is|it|al|ar|st|to|nt|ng|se|ha|as|ou|io|le|ve|co|me|de|hi|ri|ro|ic|ne|ea|ra|ce|li|ch|ll|be|ma|si|om|ur))"
DICTIONARY = (
    "account", "admin", "alpha", "answer", "apple", "backup", "banner", "before", "block", "build", "cache", "change", "class", "client", "cloud", "color",
    "config", "content", "count", "create", "data", "date", "default", "delete", "demo", "document", "dummy", "error", "event", "example", "field", "file",
    "first", "folder", "format", "function", "group", "header", "here", "home", "host", "image", "index", "input", "insert", "item", "key", "label", "last",
    "level", "line", "list", "local", "login", "main", "manager", "message", "method", "model", "module", "month", "name", "number", "object", "option",
    "order", "output", "package", "page", "parser", "pass", "password", "path", "place", "post", "print", "process", "project", "public", "query", "read",
    "record", "report", "request", "result", "sample", "schema", "screen", "search", "secret", "section", "server", "service", "session", "setting", "source",
    "start", "state", "status", "string", "style", "system", "table", "target", "test", "text", "title", "token", "type", "update", "upload", "user", "utils",
    "value", "version", "view", "widget", "window", "word", "world", "write", "year", "your",
)
FEATURES = (
    "length", "digits", "uppers", "lowers", "others", "distinct", "transitions", "pairs", "covered", "hex", "digits_only", "longest_run",
    "secret_before", "harmless_before", "harmless_after", "harmless_path", "quoted", "assigned", "repeats", "named", "reference", "parts",
)
TREES, DEPTH, SEED = 40, 8, 17
#: Characters of neighbouring text that the forest sees on each side.
NEAR = 48


def with_features(rows: DataFrame) -> DataFrame:
    """``rows`` (value, assigned, before, after, path) with one DOUBLE column for each feature."""
    v, n = F.col("value"), F.greatest(F.char_length("value"), F.lit(1))
    share = lambda pattern: (F.regexp_count(v, F.lit(pattern)) / n).cast("double")
    runs = v
    for pattern, mark in ((r"[a-z]+", "a"), (r"[A-Z]+", "A"), (r"[0-9]+", "0"), (r"[^A-Za-z0-9]+", "-")):
        runs = F.regexp_replace(runs, pattern, mark)
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    longest = F.array_max(F.transform(F.split(v, r"[^A-Za-z]+"), lambda x: F.char_length(x)))
    made = {
        "length": F.char_length("value").cast("double"),
        "digits": share("[0-9]"),
        "uppers": share("[A-Z]"),
        "lowers": share("[a-z]"),
        "others": share("[^A-Za-z0-9]"),
        "distinct": (F.size(F.array_distinct(F.split(v, ""))) / n).cast("double"),
        "transitions": (F.char_length(runs) / n).cast("double"),
        "pairs": share(COMMON_PAIRS),
        "covered": (1 - F.char_length(F.regexp_replace(F.lower(v), "|".join(DICTIONARY), "")) / n).cast("double"),
        "hex": flag(v.rlike("^[0-9a-fA-F]+$")),
        "digits_only": flag(v.rlike("^[0-9+-]+$")),
        "longest_run": F.coalesce(longest, F.lit(0)).cast("double"),
        "secret_before": flag(F.col("before").rlike(SECRET_WORDS) | F.col("assigned")),
        "harmless_before": flag(F.col("before").rlike(HARMLESS_WORDS)),
        "harmless_after": flag(F.col("after").rlike(HARMLESS_WORDS)),
        "harmless_path": flag(F.col("path").rlike(HARMLESS_PATHS)),
        "quoted": flag(F.col("after").rlike("^[\"']")),
        "assigned": flag(F.col("assigned")),
        "repeats": share(r"(.)(?=\1)"),
        "named": flag(F.col("after").rlike(r"^[\"']?\s{0,3}[:=]")),
        "reference": flag(v.rlike(REFERENCE)),
        "parts": F.regexp_count(v, F.lit(r"[a-z0-9][/_.-][a-z]|[a-z][A-Z][a-z]{2}")).cast("double"),
    }
    return rows.select("*", *[made[name].alias(f"f_{name}") for name in FEATURES])


def labelled_findings(spark: SparkSession, n: int = 4800) -> DataFrame:
    """Labelled findings by a fixed rule: (value, assigned, before, after, path, label), ``n`` rows.

    Each number takes one of the kinds below; md5 of the number fills in what is random.
    """
    r = lambda salt: F.md5(F.concat(F.col("id").cast("string"), F.lit(f":{salt}")))
    pick = lambda salt, of: F.element_at(F.array(*[F.lit(x) for x in of]), (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(of))) + 1).cast("int"))
    hex40, hex64 = F.substring(F.sha2(r("a"), 256), 1, 40), F.sha2(r("b"), 256)
    mixed = F.regexp_replace(F.base64(F.unhex(F.sha2(r("c"), 256))), "[=/+]", "")
    digits = F.substring(F.regexp_replace(F.concat(F.sha2(r("d"), 256), F.lit("4929111122223333")), "[a-f]", ""), 1, 16)
    upper = F.upper(F.substring(mixed, 1, 16))
    word = lambda salt: pick(salt, DICTIONARY)
    names = ("token", "api_key", "secret", "password", "access_key", "auth_token")
    plain = ("it was said that the", "and then he saw", "of the day in", "as we know, by", "les mots de la", "und das ist", "")
    code, docs = ("src/app.py", "deploy/prod.env", "conf/settings.yml", "src3", "src11", "src0"), ("tests/test_app.py", "docs/readme.md", "examples/a.yml", "vendor/lock.json", "src5")
    lead = lambda salt: F.concat(pick(salt, plain), F.lit(" "))
    given = lambda salt: F.concat(pick(salt, plain), F.lit(" "), pick(f"{salt}n", names), pick(f"{salt}e", (' = "', "=", ": ", ' : "')))
    mark = pick(28, ("_", "-", "/"))
    syllable = lambda salt: pick(salt, ("th", "er", "on", "an", "re", "in", "en", "es", "ti", "or", "te", "st", "la", "ri", "mo", "ung", "ment", "ou", "sch", "ver"))
    letters = F.regexp_replace(F.concat(mixed, F.base64(F.unhex(F.sha2(r("e"), 256)))), "[0-9=/+]", "")
    long_name = lambda salt: F.concat(lead(salt), pick(f"{salt}p", ("", "export ", "my_company_production_", "AWS_", "DB_")), pick(f"{salt}q", ("PASSWORD", "db_password", "secret_key", "ACCESS_KEY_ID", "passwd", "token")), pick(f"{salt}e", ("=", " = ", ": ", ' = "', ' : "')))
    number = pick(60, ("1", "2", "7", "42", "99", "123", "2024"))
    dressed = F.concat(F.translate(F.initcap(word(61)), "oea", "034"), pick(62, ("&", "!", "#", "$", "-", "")), number, pick(63, ("x", "Q", "!", "")))
    site = pick(64, ("https://h/x?sig=", "https://example.com/hooks/", "https://host.net/a?b=1&key=", "https://", "STRIPE_KEY=", "export GH_PAT=", "key.", "id="))
    joint = pick(104, ("-", "_", "/", "-"))
    yes, no, empty = F.lit(True), F.lit(False), F.lit("")
    kinds = [
        # value, assigned, before, after, path, label
        (hex40, yes, given(1), pick(2, ('"', "", '" and')), pick(3, code), 1),
        (F.substring(mixed, 1, 32), yes, given(4), pick(5, ('"', "")), pick(6, code), 1),
        (F.concat(pick(7, ("ghp_", "sk_live_", "xoxb-", "glpat-", "")), F.substring(mixed, 3, 30)), no, lead(8), pick(9, ('"', " and", "")), pick(10, code), 1),
        (F.concat(F.lit("AKIA"), upper), no, lead(11), pick(12, ('"', " ", "")), pick(13, code), 1),
        (F.substring(mixed, 5, 12), yes, given(14), F.lit('"'), pick(15, code), 1),
        (F.substring(hex64, 1, 32), yes, given(16), F.lit('"'), pick(17, code), 1),
        (hex40, no, F.concat(lead(18), pick(19, ("commit ", "revision ", "sha1: ", "hash "))), empty, pick(20, code + docs), 0),
        (hex64, no, F.concat(lead(21), pick(22, ("sha256: ", "checksum ", "digest ", "integrity "))), empty, pick(23, code + docs), 0),
        (digits, no, F.concat(lead(24), pick(25, ("", "phone ", "order number ", "card "))), pick(26, (" and", "", " of the")), pick(27, code + docs), 0),
        (F.concat(word(29), mark, word(30), mark, word(31), mark, pick(32, ("1", "22", "v2", "2024"))), no, lead(33), pick(34, ("", " of")), pick(35, code + docs), 0),
        (F.concat(pick(36, ("your_", "example_", "dummy-", "my_")), word(37), pick(38, ("_key_here", "_token", "123", "_password"))), yes, given(39), F.lit('"'), pick(40, code + docs), 0),
        (F.concat_ws("-", F.substring(r("u"), 1, 8), F.substring(r("u"), 9, 4), F.substring(r("u"), 13, 4), F.substring(r("u"), 17, 4), F.substring(r("u"), 21, 12)), no, F.concat(lead(41), pick(42, ("uuid ", "id ", ""))), empty, pick(43, code + docs), 0),
        (F.repeat(pick(44, ("x", "0", "ab", "1234", "X")), 16), yes, given(45), F.lit('"'), pick(46, code + docs), 0),
        (F.substring(mixed, 1, 24), yes, F.concat(given(47), F.lit("example ")), F.lit('"'), pick(48, ("tests/test_app.py", "docs/readme.md", "examples/a.yml")), 0),
        (F.concat(word(49), word(50), word(51), F.lit("2")), no, lead(52), empty, pick(53, code + docs), 0),
        (F.concat(F.lit("AKIA"), upper), yes, long_name(70), pick(71, ("", '"', " and")), pick(72, code), 1),
        (F.concat(pick(73, ("ghp_", "sk_live_", "", "")), F.substring(mixed, 2, 22)), no, F.concat(lead(74), site), pick(75, ("", " and", "@github.com/a", "/x")), pick(76, code), 1),
        (F.concat(F.lit("eyJhbGciOiJIUzI1NiJ9.eyJ"), F.substring(mixed, 1, 30), F.lit("."), letters, F.substring(mixed, 3, 20)), F.col("id") % 2 == 0, lead(78), pick(79, ("", '"', " and")), pick(80, code), 1),
        (F.concat(word(81), number), yes, long_name(82), pick(83, ("", '"', " and", "@host/db")), pick(84, code), 1),
        (dressed, yes, pick(85, ("https://user:", "my_company_production_database_password = \"", "password = ", "pwd=", "db.passwd: ")), pick(86, ('"', "", " and", "@host/db")), pick(87, code), 1),
        (F.substring(letters, 1, 24), no, F.concat(lead(88), pick(89, ("", "", "=", "key="))), pick(90, ("", " and", '"')), pick(91, code), 1),
        (pick(92, ("the", "he", "was", "and", "not", "in", "of", "que", "les", "und", "der", "la", "required", "optional", "none", "null", "true", "false", "string", "5", "12", "100", "3600")), yes, given(93), pick(94, (" of the", " and", "", ".")), pick(95, code + docs), 0),
        (pick(96, ("${DB_PASSWORD}", "<password>", "os.environ[", "%s", "****", "{{token}}", "getenv(KEY)", "process.env.TOKEN", "https://example.com/login", "$TOKEN")), yes, long_name(97), pick(98, ('"', "", " and")), pick(99, code + docs), 0),
        (F.concat(*[syllable(f"y{k}") for k in range(8)], pick(100, ("", "s", "e", "ly"))), no, lead(101), pick(102, ("", " of", ".", ",")), pick(103, code + docs), 0),
        (F.concat(pick(105, ("", "well", "en", "2024")), joint, word(106), joint, syllable("z1"), joint, word(107), joint, word(108)), no, F.concat(lead(109), pick(110, ("", "https://example.com", ""))), pick(111, ("", " of", ".html", "=", "@mail.example.com")), pick(112, code + docs), 0),
        (F.upper(F.concat_ws("_", word(113), word(114), pick(115, ("PASSWORD", "TOKEN", "API_KEY", "ID")))), no, lead(116), pick(117, ("=", " = ", ": ", "")), pick(118, code + docs), 0),
        (F.concat(word(119), F.initcap(word(120)), F.initcap(word(121)), pick(122, ("", "Id", "2"))), no, F.concat(lead(123), pick(124, ("", ".", "="))), pick(125, ("", " of", "(", " =")), pick(126, code + docs), 0),
        (F.concat(word(127), word(128), word(129), number), no, lead(130), pick(131, ("@mail.example.com", "@example.com and")), pick(132, code + docs), 0),
    ]
    kind = F.pmod(F.col("id"), F.lit(len(kinds)))
    made = []
    for low in range(0, len(kinds), 7):  # a few kinds a projection: generated code of all of them is longer than the JVM takes
        some = kinds[low : low + 7]
        rows = F.array(*[F.struct(v.alias("value"), a.alias("assigned"), b.alias("before"), c.alias("after"), p.alias("path"), F.lit(float(y)).alias("label")) for v, a, b, c, p, y in some])
        ids = spark.range(0, n, 1, 1).filter((kind >= low) & (kind < low + len(some)))
        made.append(ids.select(F.element_at(rows, (kind - low + 1).cast("int")).alias("row")).select("row.*"))
    return reduce(DataFrame.union, made)


def train(findings: DataFrame) -> PipelineModel:
    """A forest over the features of labelled findings; rows with a null value or label take no part."""
    rows = written(with_features(findings.filter("value IS NOT NULL AND label IS NOT NULL")))
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED)
    return Pipeline(stages=[VectorAssembler(inputCols=[f"f_{name}" for name in FEATURES], outputCol="features"), forest]).fit(rows)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """One row for each candidate: doc_id, start (in characters, from 0), value, assigned, before, after, path."""
    uid = F.monotonically_increasing_id()
    text = F.coalesce(F.col(text_col), F.lit(""))
    cut = docs.select(
        uid.alias("uid"),
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path"),
        F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)).alias("found"),
        text.alias("text"),
    ).filter(F.size("found") > 0)
    # Piece k stands before finding k; the last piece stands after the last one.
    cut = cut.withColumn("pieces", F.split("text", CANDIDATE, -1)).drop("text")
    hit = lambda x, k: F.struct(
        x.alias("whole"),
        F.char_length(F.get("pieces", k)).alias("gap"),
        F.right(F.get("pieces", k), F.lit(NEAR)).alias("before"),
        F.left(F.get("pieces", k + 1), F.lit(NEAR)).alias("after"),
    )
    each = cut.select("uid", "doc_id", "path", F.posexplode(F.transform("found", hit)).alias("k", "hit")).select("uid", "doc_id", "path", "k", "hit.*")
    so_far = Window.partitionBy("uid").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    gone = F.coalesce(F.sum(F.col("gap") + F.char_length("whole")).over(so_far), F.lit(0)) + F.col("gap")
    jwt, assigned, login = F.col("whole").rlike(f"^{JWT}$"), F.col("whole").rlike(f"^{LEAD}"), F.col("whole").rlike("^//[^/:]*:")
    value = (
        F.when(F.col("whole").rlike(f"^{KEY_HEAD}$"), F.col("whole"))
        .when(login, F.regexp_extract("whole", "(?s)^//[^:]*:(.*)$", 1))
        .when(jwt, F.regexp_extract("whole", f"({JWT_PARTS})$", 1))
        .when(assigned, F.regexp_extract("whole", f"(?s)^{LEAD}(.*)$", 1))
        .otherwise(F.col("whole"))
    )
    placed = each.select("uid", "k", "doc_id", "path", "before", "after", "whole", gone.alias("at"), value.alias("value"), (login | (assigned & ~jwt)).alias("assigned"), jwt.alias("jwt"))
    lead = F.char_length("whole") - F.char_length("value")
    placed = placed.withColumn("lead", lead).withColumn("name", F.expr("left(whole, lead)"))
    # The parts of a web token are no tokens of their own; nor is the head of a key.
    within = F.when(F.col("jwt"), F.col("name")).when(F.col("whole").startswith("-----BEGIN"), F.lit("")).otherwise(F.col("whole"))
    placed = placed.withColumn("pieces", F.split(within, INNER, -1)).withColumn("found", F.regexp_extract_all(within, F.lit(INNER), F.lit(0)))
    last = F.size("found") - 1
    part = lambda x, k: F.struct(
        x.alias("whole"),
        F.char_length(F.get("pieces", k)).alias("gap"),
        F.right(F.concat(F.when(k == 0, F.col("before")).otherwise(F.lit("")), F.get("pieces", k)), F.lit(NEAR)).alias("before"),
        F.left(F.concat(F.get("pieces", k + 1), F.when(k == last, F.concat(F.when(F.col("jwt"), F.col("value")).otherwise(F.lit("")), F.col("after"))).otherwise(F.lit(""))), F.lit(NEAR)).alias("after"),
    )
    outer = F.struct(F.col("value").alias("whole"), F.lit(0).alias("gap"), F.concat("before", "name").alias("before"), F.col("after").alias("after"))
    parts = placed.select("uid", "k", "doc_id", "path", "at", "lead", "value", "assigned", F.posexplode(F.concat(F.array(outer), F.transform("found", part))).alias("j", "hit"))
    parts = parts.select("uid", "k", "doc_id", "path", "at", "lead", "value", "assigned", "j", "hit.*")
    inside = Window.partitionBy("uid", "k").orderBy("j").rowsBetween(Window.unboundedPreceding, -1)
    gone = F.coalesce(F.sum(F.when(F.col("j") > 0, F.col("gap") + F.char_length("whole")).otherwise(0)).over(inside), F.lit(0)) + F.col("gap")
    parts = parts.withColumn("offset", F.when(F.col("j") == 0, F.col("lead")).otherwise(gone))
    parts = parts.filter((F.col("j") == 0) | (F.col("whole") != F.col("value")))
    return parts.select(
        "doc_id", (F.col("at") + F.col("offset")).alias("start"), F.col("whole").alias("value"), (F.col("assigned") & (F.col("offset") >= F.col("lead"))).alias("assigned"), "before", "after", "path"
    )


def scan(docs: DataFrame, findings: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """Every candidate with the forest's score in 0 to 1 and its verdict: doc_id, start, value, score, secret."""
    model = train(findings)
    scored = model.transform(with_features(candidates(docs, id_col, text_col, path_col)))
    score = F.element_at(vector_to_array("probability"), 2)
    head = F.col("value").rlike(f"^{KEY_HEAD}$")
    score = F.when(head, F.lit(1.0)).otherwise(score)
    return scored.select("doc_id", "start", "value", score.alias("score"), (score >= 0.5).alias("secret"))

"""Secret scans with a random forest that removes false positives (operator 9).

All of it is DataFrame and SQL functions: candidates are cut out by regular
expressions, features are string functions, and the forest is the JVM's own,
trained from labelled findings and applied as a DataFrame transformation.

Candidates are blocks of private keys, runs of 20 or more key-like characters with a
digit, quoted values of 8 or more characters behind = or :, whatever stands behind a
key word and = or : (6 characters or more, or a whole quoted value), and passwords in
URLs.  Features: length, character classes and transitions, common letter pairs,
dictionary coverage, whether the value looks like or stands in a path, and the
neighbouring words.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Names that values are assigned to (fixed values).
ASSIGNED_NAMES = r"(?i:passw(?:or)?d|passwd|passphrase|pass|pwd|secret|token|credentials?|bearer|(?:api|access|private|secret|signing|encryption|session|master)[_ -]?key|apikey)"

#: The kinds of candidates; the first that fits at a place is taken.
KINDS = (
    r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\s:,.\\-]{1,20000}?-----END [A-Z ]{0,40}PRIVATE KEY-----",
    r"""(?<=["'])(?<=[=:] {0,2}["'])(?<=NAMES["']? {0,2}[=:] {0,2}["'])[^\n"']{6,200}(?=["'])""".replace("NAMES", ASSIGNED_NAMES),
    r"(?<=:)(?<=://[^\s/:@]{0,64}:)[^\s/:@]{4,}+(?=@)",
    r"""(?<=[=:] {0,2})(?<=NAMES["']? {0,2}[=:] {0,2})(?![=: ])[^\s"',;]{6,}+""".replace("NAMES", ASSIGNED_NAMES),
    r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{20,}+={0,2}",
    r"""(?<=["'])(?<=[=:] {0,2}["'])[^\s"']{8,}+""",
)
CANDIDATE = "|".join(KINDS)
#: Marks the ends of a candidate while a text is cut; a text's own occurrences are read as the character after it.
MARK, OTHER = "\ue000", "\ue001"
CONTEXT = 48

#: Word lists (fixed values).
KEY_WORDS = r"(?i)(key|secret|token|pass(wor|w|phrase)?d?|pwd|auth|bearer|credential)"
HARMLESS_WORDS = r"(?i)(\b(example|sample|dummy|placeholder|commit|revision|checksum|digest|sha-?(1|256|512)|md5|etag|uuid|guid|hash|version|build|integrity|fingerprint|isbn|doi)\b|;base64,)"
PLACEHOLDERS = r"(?i)(example|sample|dummy|placeholder|your|change|insert|redacted|test|xxxx|todo|foobar|abcdef|123456|\*\*\*|^<|^\$|\(|\{)"
PREFIXES = r"^(AKIA|ASIA|ghp_|gho_|ghs_|glpat-|sk_live_|rk_live_|sk-|xox[abprs]-|AIza|eyJ|ya29)"
DICTIONARY = r"(the|and|ing|ion|for|with|that|this|from|have|not|are|was|you|your|all|can|her|his|one|our|out|day|get|has|him|how|man|new|now|old|see|two|way|who|its|did|yes|part|chapter|section|page|file|path|user|name|data|home|lib|usr|bin|var|src|main|test|example|sample|image|index|page|html|http|www|com|org|net|version|release|build|key|token|secret|pass|word|value|string|number|class|object|method|public|private|static|default|config|server|client|local|host|port|required|optional|none|null|true|false|enabled|disabled|undefined|empty|given|env|process|environ|get|set)"
PAIRS = r"(?=(th|he|in|er|an|re|on|at|en|nd|ti|es|or|te|of|ed|is|it|al|ar|st|to|nt|ng|se|ha|as|ou|io|le|ve|co|me|de|hi|ri|ro|ic|ne|ea|ra|ce|li|ch|ll|be|ma|si|om|ur))"

LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def features(value: Column, before: Column, after: Column) -> dict[str, Column]:
    """Numbers that describe a candidate and its surroundings; before and after: the text around it."""
    n = F.greatest(F.length(value), F.lit(1)).cast("double")
    share = lambda keep: F.length(F.regexp_replace(value, keep, "")) / n
    flag = lambda test: F.when(test, 1.0).otherwise(0.0)
    classes = F.translate(value, LOWER + UPPER + DIGITS, "a" * 26 + "A" * 26 + "0" * 10)
    near = F.concat(F.right(before, F.lit(CONTEXT)), F.lit(" "), F.left(after, F.lit(CONTEXT // 2)))
    return {
        "length": n,
        "digits": share("[^0-9]"),
        "upper": share("[^A-Z]"),
        "vowels": share("[^aeiouAEIOU]"),
        "marks": share("[A-Za-z0-9]"),
        "transitions": F.length(F.regexp_replace(classes, r"(.)\1+", "$1")) / n,
        "pairs": F.regexp_count(F.lower(value), F.lit(PAIRS)) / n,
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / F.least(n, F.lit(40.0)),
        "spaces": share("[^ ]"),
        "hex": flag(value.rlike("^[0-9a-fA-F]+$")),
        "uuid": flag(value.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")),
        "run": flag(value.rlike(r"(.)\1{4,}")),
        "prefix": flag(value.rlike(PREFIXES)),
        "placeholder": flag(value.rlike(PLACEHOLDERS)),
        "dictionary": 1.0 - F.length(F.regexp_replace(F.lower(value), DICTIONARY, "")) / n,
        "path": share("[^/]") + flag(before.rlike(r"(://|[/@.\\])\S*$")) + flag(after.rlike(r"^[./\\@]\w")),
        "key_word": flag(F.right(before, F.lit(CONTEXT)).rlike(KEY_WORDS)),
        "harmless_word": flag(near.rlike(HARMLESS_WORDS)),
        "assigned": flag(before.rlike(r"""[=:]\s*["']?$""")),
        "named": flag(before.rlike(ASSIGNED_NAMES + r"""["']? {0,2}[=:] {0,2}["']?$""")),
        "url_login": flag(before.rlike(r"://[^\s/:@]{0,64}:$") & after.startswith("@")),
        "key_block": flag(value.startswith("-----BEGIN")),
        "quoted": flag(before.rlike("""["']$""") & after.rlike("""^["']""")),
    }


def labelled_findings(spark: SparkSession, n: int = 9_600) -> DataFrame:
    """value, before, after, label: n findings made by rule, one kind after the other, of both labels.

    Secrets are digests, random strings, altered words and phrases where keys are assigned, and keys of known form; the rest
    is what such a search takes for secrets: checksums, commits, identifiers, paths, long words, placeholders, settings that
    are words, and embedded data.  Names, surroundings and words are lists of their own, not those of the features.
    """
    text = F.col("id").cast("string")
    turn = F.floor(F.col("id") / KIND_COUNT)
    sha, sha1 = F.sha2(text, 256), F.sha1(text)
    mixed = F.regexp_replace(F.base64(F.unhex(F.sha2(F.concat(F.lit("m"), text), 512))), r"[+/=\r\n]", "")
    pick = lambda *words, by=1: F.element_at(F.array(*[F.lit(w) for w in words]), (F.floor(turn / by) % len(words) + 1).cast("int"))
    around = pick("we keep ", "deploy with ", "line 4\n", "", "und dann ", "mais le ", "x; ")
    name = pick("db_password", "smtp_pass", "webhook_token", "signing_key", "session_secret", "admin.passwd", "STRIPE_API_KEY", "refresh-token", "masterKey", "password", "vault_access_key", by=7)
    equals, colon, quote = pick("=", " = ", ": ", by=3), pick(": ", " = ", "=", ":"), pick("'", '"')
    cut = lambda c, low, spread: F.substring(c, F.lit(1), (F.lit(low) + turn % spread).cast("int"))
    word = pick("thonbleerinthat", "riverstonecottage", "internationalization", "blauwwalvissen", "undenvereinzulich", "montagnesduciel", by=2)
    short = pick("dragonfly", "Sunshine", "orchid", "Mountain", "walnut", "Liverpool", "kittens", by=5)
    leet = F.concat(F.translate(short, "aeios", "43105"), cut(sha, 1, 4))
    phrase = F.concat_ws(" ", pick("purple", "seven", "quiet", "marble", by=3), short, pick("lantern", "harbour", "biscuit"), pick("staple", "monday", "cloud", by=2))
    where = pick("db.internal/app", "10.0.0.7:5432/main", "broker:5672", "mail.corp.net")
    cases = [
        (sha1, F.concat(around, name, F.lit(' = "')), F.lit('" and then'), 1),
        (sha, F.concat(around, name, F.lit(': "')), F.lit('"\n'), 1),
        (cut(mixed, 24, 30), F.concat(around, name, F.lit('="')), F.lit('" the'), 1),
        (cut(mixed, 20, 44), F.concat(around, name, equals), F.lit(" of"), 1),
        (F.concat(F.lit("AKIA"), F.upper(F.substring(mixed, 1, 16))), around, F.lit(" is"), 1),
        (F.concat(F.lit("ghp_"), F.substring(mixed, 1, 36)), around, F.lit(" a"), 1),
        (cut(mixed, 8, 12), F.concat(around, name, colon, quote), quote, 1),
        (F.concat(F.lit("eyJ"), cut(mixed, 40, 30)), F.concat(around, pick("Authorization: Bearer ", "id_token: ", "jwt = ")), F.lit("\n"), 1),
        (F.substring(sha, 1, 32), F.concat(around, name, F.lit(" = '")), F.lit("'"), 1),
        (cut(sha, 8, 20), F.concat(around, name, equals), pick(" the", "\n", " and"), 1),
        (leet, F.concat(around, name, equals), pick(" the", "\n", " and"), 1),
        (F.concat(leet, pick("!", "&3", "#", "_9")), F.concat(around, name, colon, quote), quote, 1),
        (phrase, F.concat(around, name, colon, F.lit('"')), F.lit('"'), 1),
        (F.coalesce(F.when(turn % 2 == 0, leet), cut(mixed, 8, 16)), F.concat(around, pick("postgres", "mysql", "amqp", "https", by=4), F.lit("://"), pick("svc", "root", "app_rw"), F.lit(":")), F.concat(F.lit("@"), where), 1),
        (F.concat(F.lit("-----BEGIN "), pick("RSA ", "EC ", "", "OPENSSH "), F.lit("PRIVATE KEY-----\n"), mixed, F.lit("\n"), sha, F.lit("\n-----END PRIVATE KEY-----")), around, F.lit("\n"), 1),
        (cut(mixed, 10, 8), F.concat(around, name, equals), pick("\n", " or", ""), 1),
        (sha1, F.concat(around, pick("commit ", "reverts ", "sha1: ", "tree = ", 'etag: "', "parent ")), F.lit(" by"), 0),
        (sha, F.concat(around, pick("sha256:", 'digest = "', "integrity: ", "blob ", "md5 ", "checksum = ")), F.lit(" the"), 0),
        (F.concat_ws("-", F.substring(sha, 1, 8), F.substring(sha, 9, 4), F.substring(sha, 13, 4), F.substring(sha, 17, 4), F.substring(sha, 21, 12)), F.concat(around, pick('id: "', "uuid = ", "guid ", "request ")), F.lit(" was"), 0),
        (F.concat(F.lit("/usr/share/"), pick("lib", "data", "home/user"), F.lit("/page"), F.substring(sha, 1, 3), F.lit("/index")), around, F.lit(".html"), 0),
        (F.concat(word, F.substring(sha, 1, 2), F.lit("1")), around, F.lit(" the"), 0),
        (pick("your_api_key_goes_here_1", "xxxxxxxxxxxxxxxxxxxxxxx1", "example_token_1234567890", "change-me-please-0000000000", "test-token-test-token-01"), F.concat(around, name, F.lit(' = "')), F.lit('" and'), 0),
        (F.concat(F.lit("iVBORw0KGgo"), mixed), F.concat(around, F.lit("src=data:image/png;base64,")), F.lit(" of"), 0),
        (F.concat(word, F.lit("/"), F.substring(sha, 1, 6), F.lit("/"), word), F.concat(around, F.lit("https://www.site.org/")), F.lit(".html in"), 0),
        (F.regexp_replace(F.substring(sha, 1, 24), "[a-f]", "7"), around, F.lit(" in"), 0),
        (F.concat(F.lit("------"), F.substring(sha, 1, 1), F.lit("1---------------")), around, F.lit("\n"), 0),
        (pick("hello-world-1", "version-2.0.1", "the-default", "first-chapter", "no-wrap", "2024-01-15"), F.concat(around, pick("title", "name", "label", "class"), F.lit(': "')), F.lit('",'), 0),
        (pick("required", "optional", "string", "undefined", "enabled", "disabled", "nullable", "missing"), F.concat(around, name, equals), pick(" the", "\n", " and"), 0),
        (pick("********", "<password>", "${DB_PASSWORD}", "$TOKEN_VALUE", "process.env.TOKEN", "os.environ[0]", "getpass()", "changeme", "xxxxxxxx", "{{secret}}"), F.concat(around, name, colon), pick(" the", "\n"), 0),
        (pick("please enter your value", "must not be empty", "the one you were given", "forgotten? click here"), F.concat(around, name, colon, F.lit('"')), F.lit('"'), 0),
        (pick("password", "xxxx", "****", "<pass>", "changeme", "yourpass"), F.concat(around, F.lit("mysql://user:")), F.lit("@localhost"), 0),
        (F.concat(word, pick(".", ",", "")), F.concat(around, name, F.lit(": ")), pick(" the", " und"), 0),
    ]
    assert len(cases) == KIND_COUNT
    # one small plan per kind: all in one expression outgrow what the JVM compiles
    parts = [spark.range(k, n, KIND_COUNT, 1).select("id", value.alias("value"), before.alias("before"), after.alias("after"), F.lit(label).alias("label")) for k, (value, before, after, label) in enumerate(cases)]
    return reduce(DataFrame.unionByName, parts).coalesce(2)


#: Kinds of findings that are made.
KIND_COUNT = 32


def _vectors(found: DataFrame) -> DataFrame:
    columns = features(F.col("value"), F.col("before"), F.col("after"))
    out = found.select("*", *[c.cast("double").alias(f"f_{k}") for k, c in columns.items()])
    return VectorAssembler(inputCols=[f"f_{k}" for k in columns], outputCol="f_all", handleInvalid="keep").transform(out)


def train_forest(findings: DataFrame, trees: int = 40, depth: int = 8, seed: int = 11) -> RandomForestClassificationModel:
    """A forest from labelled findings (value, before, after, label); rows with nulls are left out."""
    rows = _vectors(findings.dropna(subset=["value", "before", "after", "label"])).withColumn("label", F.col("label").cast("double"))
    model = RandomForestClassifier(featuresCol="f_all", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt", rawPredictionCol="f_raw", probabilityCol="f_probability", predictionCol="f_prediction")
    return model.fit(rows)


#: The forest from the findings made here, by Spark application: fitted once.
_FITTED: dict[str, RandomForestClassificationModel] = {}


def default_forest(spark: SparkSession) -> RandomForestClassificationModel:
    key = spark.sparkContext.applicationId
    if key not in _FITTED:
        _FITTED[key] = train_forest(labelled_findings(spark))
    return _FITTED[key]


def save_forest(model: RandomForestClassificationModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_forest(path: str) -> RandomForestClassificationModel:
    return RandomForestClassificationModel.load(path)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, tie, start (characters from 0), value, before, after of every candidate; rows equal in id and text count once."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("body")).filter(F.col("body").rlike(CANDIDATE))
    rows = rows.groupBy("id", F.xxhash64("body").alias("tie")).agg(F.first("body").alias("body"))
    parts = F.split(F.regexp_replace(F.translate("body", MARK, OTHER), CANDIDATE, f"{MARK}$0{MARK}"), MARK, -1)
    cut = rows.select("id", "tie", F.posexplode(parts).alias("pos", "value"))
    w = Window.partitionBy("id", "tie").orderBy("pos")
    cut = cut.withColumn("start", F.coalesce(F.sum(F.length("value")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    cut = cut.withColumn("before", F.right(F.lag("value").over(w), F.lit(2 * CONTEXT))).withColumn("after", F.left(F.lead("value").over(w), F.lit(2 * CONTEXT)))
    return cut.filter("pos % 2 = 1").select("id", "tie", "start", "value", "before", "after")


def secret_scan(docs: DataFrame, findings: DataFrame | None = None, model: RandomForestClassificationModel | None = None, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.5) -> DataFrame:
    """Every candidate with its score and whether the forest takes it for a secret.

    Returns id, tie (hash of the text), start, n_chars, value, score, secret.  findings: labelled findings to train from
    (default: ``labelled_findings``); model: a forest trained before.  Texts of any length are scanned whole.  Null and empty texts have no candidates; rows equal in id and text are scanned
    once; null ids are kept; an empty table gives no rows; other columns are not read.
    """
    if model is None:
        model = default_forest(docs.sparkSession) if findings is None else train_forest(findings)
    scored = model.transform(_vectors(candidates(docs, id_col, text_col)))
    score = F.round(vector_to_array("f_probability")[1], 6)
    return scored.select("id", "tie", "start", F.length("value").cast("long").alias("n_chars"), "value", score.alias("score"), (score >= cut).alias("secret"))


def mask_secrets(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """docs with every secret of found replaced by mask; all rows and columns stay, documents without secrets as they are."""
    spans = found.filter("secret").groupBy("id", "tie").agg(F.array_sort(F.collect_list(F.struct("start", "n_chars"))).alias("_spans")).withColumnsRenamed({"id": "_id", "tie": "_tie"})
    body = F.col(text_col).cast("string")
    some = docs.filter(F.coalesce(body.rlike(CANDIDATE), F.lit(False)))
    rest = docs.filter(~F.coalesce(body.rlike(CANDIDATE), F.lit(False)))
    joined = some.join(spans, F.col(id_col).eqNullSafe(F.col("_id")) & (F.xxhash64(body) == F.col("_tie")), "left")
    # text between the ends of one span and the start of the next
    n = F.size("_spans")
    start = lambda i: F.when(i == n, F.length(text_col).cast("long") + 1).otherwise(F.get("_spans", i)["start"] + 1)
    end = lambda i: F.when(i == 0, F.lit(1).cast("long")).otherwise(F.get("_spans", i - 1)["start"] + F.get("_spans", i - 1)["n_chars"] + 1)
    pieces = F.transform(F.sequence(F.lit(0), n), lambda i: F.substring(body, end(i).cast("int"), (start(i) - end(i)).cast("int")))
    masked = F.when(F.col("_spans").isNotNull(), F.array_join(pieces, mask)).otherwise(body)
    return joined.withColumn(text_col, masked).select(*docs.columns).unionByName(rest)

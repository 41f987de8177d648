"""Secret scan: published key formats and assignments, with a random forest that removes
false positives; DataFrame and SQL functions only.

Candidates are what one regular expression finds in a whole text (key formats, values
assigned to names that contain a word such as `password`, whatever stands before or behind
it in the name, long tokens of mixed characters). Each becomes a
row of features: length, shares of character classes, transitions between classes and
common letter pairs, how much of it dictionary words cover, shapes (hex, UUID), the words
in front and behind, and the path. The forest (Spark ML, seeded) is trained from labelled
findings; `labelled_findings` makes a bounded table of them from published formats and
from the usual false alarms (checksums, commit ids, UUIDs, placeholders, identifiers,
paths), and any table with the same columns can take its place.

The texts are scanned in place; only candidates move, so a source that holds a third of
the rows is no hot key, and memory is bounded by a row.

Edge cases: null and empty texts have no findings; null paths count as empty; repeated
rows are scanned alike, each under its own row number; equal candidates at other places
are findings of their own; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import cut, not_null_text, table

#: Published formats of keys and tokens, by rule.
FORMATS = {
    "aws_access_key": r"(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])",
    "github_token": r"gh[pousr]_[A-Za-z0-9]{36,255}",
    "slack_token": r"xox[abprs]-[A-Za-z0-9-]{10,}",
    "google_api_key": r"AIza[0-9A-Za-z_-]{35}",
    "stripe_key": r"[sr]k_live_[0-9A-Za-z]{16,}",
    "json_web_token": r"eyJ[A-Za-z0-9_-]{8,4096}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    "private_key": r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----",
}
NAMES = r"(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth[_-]?key|credential)"
RUN = r"[A-Za-z0-9_.+/-]"  # a whole name, with its qualifiers: taken at once, so that time is linear in its length
TO_VALUE, VALUE = r"[\"']?[ \t]{0,3}[:=][ \t]{0,3}[\"']?", r"[^\s\"'<>,;]{8,}"
ASSIGN = f"(?:(?<!{RUN})(?={RUN}*?{NAMES}){RUN}++|{NAMES}){TO_VALUE}"
TOKEN = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{24,}"  # a run is entered at its start only, so time is linear
PATTERN = "(?<![A-Za-z0-9_])(?:" + "|".join([*FORMATS.values(), ASSIGN + VALUE, TOKEN]) + ")"

#: Words whose letters count as covered by the dictionary, and word groups.
DICTIONARY = """able about access account action admin after again application apple before board build button
change char check class client code command config connect container content count create current data date default
delete demo description document download dummy element email error event example false field file filter find first
format from function global handler hello host house image index info input item label language last left length level
line link list load local login mail main manager master message method model module monkey name network number object
offset open option order output page parent password path place player point position private process product program
project property public query read record red remote request required reset resource response result return right root
sample search secret section select server service session setting simple size source start state status string style
summer sun system table target template test text time title token true type update user value version view water where
width window with word world write your""".split()
PLACEHOLDER = "example|sample|dummy|changeme|placeholder|your|xxxx|<|\\$\\{|todo|test|fake|redacted|\\*\\*\\*"
KEYWORDS = "pass|secret|token|key|auth|cred|login|private"
HARMLESS = "commit|sha|checksum|hash|md5|uuid|guid|digest|integrity|version|build|etag|revision|nonce|fingerprint|image"
PAIRS = "th|he|in|er|an|re|on|at|en|nd|ti|es|or|te|of|ed|is|it|al|ar|st|to|nt|ng|se|ha|as|ou|io|le|ve|co|me|de|hi|ri|ro|ic|ne|ea|ra|ce"
FEATURES = ["length", "digits", "uppers", "marks", "transitions", "pairs", "distinct", "dictionary", "hex", "uuid", "runs",
            "placeholder", "known", "assigned", "keyword", "harmless", "slashes", "path_test"]
THRESHOLD = 0.5


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """row, id, path, at (0-based code point), rule, candidate, before, behind of each candidate."""
    text = not_null_text(text_col)
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col in docs.columns else F.lit("")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), path.alias("path"), text.alias("text"))
    found = rows.where(F.col("text").rlike(PATTERN)).select(
        "row", "id", "path", F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)).alias("hits"), F.split("text", PATTERN, -1).alias("gaps"))
    each = found.select("row", "id", "path", F.posexplode(F.transform("hits", lambda h, i: F.struct(
        h.alias("hit"), F.length(F.get("gaps", i)).alias("gap"), F.right(F.get("gaps", i), F.lit(48)).alias("before"), F.left(F.get("gaps", i + 1), F.lit(24)).alias("behind")))).alias("pos", "h"))
    so_far = Window.partitionBy("row").orderBy("pos")
    placed = each.withColumn("end", F.sum(F.col("h.gap") + F.length("h.hit")).over(so_far))
    value = F.regexp_replace("h.hit", f"^{ASSIGN}(?={VALUE})", "")
    rule = F.lit("token")
    rule = F.when(value != F.col("h.hit"), F.lit("assignment")).otherwise(rule)
    for name, pattern in FORMATS.items():
        rule = F.when(F.col("h.hit").rlike("^(?:" + pattern + ")"), F.lit(name)).otherwise(rule)
    head = F.left(F.col("h.hit"), F.length("h.hit") - F.length(value))
    return placed.select("row", "id", "path", (F.col("end") - F.length(value)).alias("at"), rule.alias("rule"), value.alias("candidate"),
                         F.concat(F.col("h.before"), head).alias("before"), F.col("h.behind").alias("behind"))


def with_features(found: DataFrame) -> DataFrame:
    c, low = F.col("candidate"), F.lower("candidate")
    n = F.greatest(F.length(c), F.lit(1)).cast("double")
    share = lambda pattern: F.regexp_count(c, F.lit(pattern)) / n
    flag = lambda column, pattern: F.coalesce(F.lower(column).rlike(pattern), F.lit(False)).cast("double")
    cover = (F.length(low) - F.length(F.regexp_replace(low, "(?:" + "|".join(sorted(DICTIONARY, key=len, reverse=True)) + ")", ""))) / n
    known = F.col("rule").isin(*FORMATS).cast("double")
    return found.withColumns({
        "length": n, "digits": share("[0-9]"), "uppers": share("[A-Z]"), "marks": share("[^A-Za-z0-9]"),
        "transitions": F.regexp_count(c, F.lit("(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[a-z0-9])|(?<=[0-9])(?=[A-Za-z])")) / n,
        "pairs": F.regexp_count(low, F.lit("(?=(?:" + PAIRS + "))")) / n,
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / n, "dictionary": cover,
        "hex": flag(c, "^[0-9a-f]+$"), "uuid": flag(c, "^[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}$"),
        "runs": F.regexp_count(c, F.lit(r"(.)\1\1")) / n, "placeholder": flag(c, PLACEHOLDER), "known": known,
        "assigned": flag(F.col("before"), "[:=][ \t]*[\"']?$"), "keyword": flag(F.right("before", F.lit(24)), KEYWORDS),
        "harmless": flag(F.right("before", F.lit(24)), HARMLESS), "slashes": share("[/=+_.-]"), "path_test": flag(F.col("path"), "test|example|sample|mock|fixture|doc/"),
    })


def labelled_findings(spark: SparkSession, rows: int = 4000, seed: str = "") -> DataFrame:
    """A bounded table of labelled findings: path, rule, candidate, before, behind, label.

    Made with hashes of the row number and the seed, so it is the same each time; another
    seed gives other values, for a held-out table."""
    h = lambda salt: F.sha2(F.concat_ws(":", F.lit(seed + salt), F.col("i").cast("string")), 256)
    mixed = lambda salt: F.translate(F.base64(F.unhex(h(salt))), "+/=", "xYz")
    name = lambda names, salt: F.get(F.array(*map(F.lit, names)), F.pmod(F.xxhash64(F.lit(seed + salt), "i"), F.lit(len(names))).cast("int"))
    word = lambda salt: name(DICTIONARY, salt)
    number = lambda salt, low, high: (F.pmod(F.xxhash64(F.lit(seed + salt), "i"), F.lit(high - low)) + low).cast("string")
    part = lambda c, a, b: F.substring(c, a, b)
    secret_names, hash_names = ["password=", "token = \"", "secret: ", "api_key=", "pwd=", "access_key = '"], ["commit ", "sha256:", "checksum ", "md5 ", "etag=\"", "digest: ", "version "]
    lit = F.lit
    kinds = [  # (rule, candidate, before, label)
        ("aws_access_key", F.concat(lit("AKIA"), F.upper(part(mixed("a"), 1, 16))), lit("and "), 1),
        ("aws_access_key", F.concat(lit("ASIA"), F.upper(part(mixed("b"), 3, 16))), lit("key: "), 1),
        ("github_token", F.concat(lit("ghp_"), part(mixed("c"), 1, 36)), lit("use "), 1),
        ("slack_token", F.concat(lit("xoxb-"), part(F.conv(part(h("d"), 1, 12), 16, 10), 1, 11), lit("-"), part(mixed("d"), 1, 24)), lit(" "), 1),
        ("google_api_key", F.concat(lit("AIza"), part(mixed("e"), 1, 35)), lit("key="), 1),
        ("stripe_key", F.concat(lit("sk_live_"), part(mixed("f"), 1, 24)), lit(" "), 1),
        ("assignment", part(h("g"), 1, 18), name(secret_names, "g"), 1),
        ("assignment", part(h("h"), 1, 40), name(secret_names, "h"), 1),
        ("assignment", part(mixed("i"), 1, 20), name(secret_names, "i"), 1),
        ("assignment", F.concat(F.initcap(word("j")), part(mixed("j"), 1, 6), lit("!"), part(h("j"), 1, 3)), name(secret_names, "j"), 1),
        ("assignment", F.concat(F.initcap(word("ba")), number("ba", 1950, 2030), name(["", "!", "#", "$"], "bb")), name(secret_names, "ba"), 1),
        ("assignment", F.concat(word("bc"), word("bd"), number("bc", 1, 100)), name(secret_names, "bc"), 1),
        ("assignment", F.concat(word("be1"), word("bf"), word("bg"), number("be1", 1, 10)), name(secret_names, "be1"), 1),
        ("assignment", F.concat(word("bh"), lit("-"), word("bi"), name(["", "-", "!"], "bj"), number("bh", 1, 1000)), name(secret_names, "bh"), 1),
        ("assignment", F.concat(word("bk"), number("bk", 1, 10), word("bl"), name(["", "!", "@"], "bl")), name(secret_names, "bk"), 1),
        ("assignment", part(h("bm"), 1, 8), name(secret_names, "bm"), 1),
        ("token", part(mixed("k"), 1, 40), lit("auth key "), 1),
        ("private_key", lit("-----BEGIN RSA PRIVATE KEY-----"), lit("\n"), 1),
        ("token", part(h("l"), 1, 40), name(hash_names, "l"), 0),
        ("token", h("m"), name(hash_names, "m"), 0),
        ("token", part(h("n"), 1, 32), name(hash_names, "n"), 0),
        ("token", F.concat_ws("-", part(h("o"), 1, 8), part(h("o"), 9, 4), part(h("o"), 13, 4), part(h("o"), 17, 4), part(h("o"), 21, 12)), name(["uuid=", "id ", "guid: ", "request "], "o"), 0),
        ("assignment", F.concat(word("p"), lit("_"), word("q"), lit("_"), word("r")), name(secret_names, "p"), 0),
        ("assignment", F.concat(name(["your", "example", "changeme", "dummy", "test"], "q"), lit("_"), word("q"), lit("123")), name(secret_names, "q"), 0),
        ("assignment", F.concat(F.repeat(lit("x"), 8), part(F.conv(part(h("r"), 1, 4), 16, 10), 1, 4)), name(secret_names, "r"), 0),
        ("assignment", F.concat(lit("${"), F.upper(word("ca")), lit("_"), F.upper(word("cb")), lit("}")), name(secret_names, "ca"), 0),
        ("assignment", F.concat(word("cc"), lit("."), word("cd"), lit("."), word("ce")), name(secret_names, "cc"), 0),
        ("assignment", F.concat(word("cf"), word("cg")), name(secret_names, "cf"), 0),
        ("assignment", F.concat(word("ch"), F.initcap(word("ci")), F.initcap(word("cj"))), name(secret_names, "ch"), 0),
        ("assignment", F.concat(word("cm"), lit("("), word("cn"), name(["", "_", "."], "cn"), word("co"), lit(")")), name(secret_names, "cm"), 0),
        ("assignment", F.concat(name(["YOUR_", "MY_", "your-", "<"], "cp"), F.upper(word("cp")), lit("_"), F.upper(word("cq"))), name(secret_names, "cp"), 0),
        ("assignment", F.substring(F.repeat(name(["x", "*", "X", "0", "."], "cr"), 24), 1, F.pmod(F.xxhash64(lit(seed + "cr"), "i"), lit(14)) + 8), name(secret_names, "cr"), 0),
        ("assignment", F.concat(F.upper(word("ck")), lit("_"), F.upper(word("cl"))), name(secret_names, "ck"), 0),
        ("aws_access_key", F.concat(lit("AKIA"), F.upper(part(F.concat(word("s"), lit("XXXXXXXXXXXXXXXX")), 1, 9)), lit("EXAMPLE")), lit("key "), 0),
        ("token", F.concat_ws("/", word("t"), word("u"), word("v"), F.concat(word("w"), lit("2.java"))), lit("see "), 0),
        ("token", F.concat(word("x"), F.initcap(word("y")), F.initcap(word("z")), F.initcap(word("t")), lit("2Handler")), lit("call "), 0),
        ("assignment", F.concat(lit("get"), F.initcap(word("aa")), lit("("), word("ab"), lit(")")), name(secret_names, "ab"), 0),
        ("token", F.concat(part(F.conv(part(h("ac"), 1, 14), 16, 10), 1, 15), part(F.conv(part(h("ac"), 20, 14), 16, 10), 1, 15)), lit("number "), 0),
    ]
    path = name(["src/main/app.py", "config/prod.yml", "src3", "deploy/.env", "notes.txt"], "path")
    made = spark.range(0, -(-rows // len(kinds)), numPartitions=1).select(F.col("id").alias("i"))
    one = F.array(*(F.struct(lit(r).alias("rule"), c.alias("candidate"), b.alias("before"), lit(y).alias("label")) for r, c, b, y in kinds))
    out = made.select("i", path.alias("path"), F.explode(one).alias("k")).select("i", "path", "k.rule", "k.candidate", F.concat(word("be"), lit(" "), F.col("k.before")).alias("before"), lit(" ").alias("behind"), "k.label")
    in_tests = F.pmod(F.xxhash64(lit(seed + "tests"), "i", "candidate"), lit(10)) < F.when(F.col("label") == 0, 3).otherwise(1)  # either kind stands in test paths
    return out.withColumn("path", F.when(in_tests, "tests/fixtures/sample.json").otherwise(F.col("path"))).limit(rows)


def train(findings: DataFrame, trees: int = 32, depth: int = 9, seed: int = 11) -> RandomForestClassificationModel:
    """A forest from labelled findings (path, rule, candidate, before, behind, label)."""
    data = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(with_features(findings)).select("features", F.col("label").cast("double").alias("label"))
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt", subsamplingRate=0.8).fit(data.coalesce(1))


def scan(docs: DataFrame, model: RandomForestClassificationModel, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source",
         threshold: float = THRESHOLD) -> DataFrame:
    """row, id, rule, at, length, candidate, score, kept of every candidate."""
    found = with_features(candidates(docs, id_col, text_col, path_col))
    scored = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(found))
    score = vector_to_array("probability")[1]
    return scored.select("row", "id", "rule", "at", F.length("candidate").cast("long").alias("length"), "candidate", score.alias("score")).withColumn("kept", F.col("score") >= threshold)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of every document with the forest's verdict."""
    found = scan(table(spark, sf_dir, "documents"), train(cut(labelled_findings(spark))))
    return found.select(F.col("id").alias("doc_id"), "rule", F.col("at").cast("long").alias("start"), "length", F.sha2("candidate", 256).alias("secret_sha256"), "score", "kept")

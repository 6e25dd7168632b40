"""Secret scans: candidates by pattern, false positives removed by a random forest, with DataFrame functions only."""

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Key characters: a run of 16 or more that holds a digit is a candidate wherever it stands; dots may join its parts, and
#: ``=`` ends it, so that NAME=value is a name and a value.
RUN = r"(?<![A-Za-z0-9_+/-])(?<![A-Za-z0-9_+/-]\.)(?=[A-Za-z0-9_+/.-]{16})(?=[A-Za-z_+/.-]*[0-9])[A-Za-z0-9_+/-]+(?:\.[A-Za-z0-9_+/-]+)*={0,2}(?<=.{16})"
#: A value of six characters or more after a word that names a secret, whatever its characters; in quotes it may hold marks.
NAMED = r"(?i:pass(?:word|wd|phrase)|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?)[\"'`]?\s{0,3}[:=]\s{0,3}"
ASSIGNED = NAMED + r"(?:\"[^\"\n]{6,200}(?=\")|'[^'\n]{6,200}(?=')|[^\s\"'`,;]{6,})"
#: The password of a URL, and the head of a private key.
IN_URL = r"://[^\s:/@]{1,64}:[^\s/@]{3,}(?=@)"
PEM = r"-----BEGIN (?:[A-Z0-9]{2,12} ){0,3}PRIVATE KEY-----"
CANDIDATE = f"{PEM}|{ASSIGNED}|{IN_URL}|{RUN}"
#: What stands before the value in a match.
LEAD = rf"^(?:{NAMED}[\"']?|://[^\s:/@]{{1,64}}:)"
#: Characters before and after a candidate that hold its neighbouring words.
BEFORE, AFTER = 48, 24
TREES, DEPTH, SEED = 25, 7, 11
THRESHOLD = 0.5

# Words before a candidate that speak for a secret, and words that speak against one.
FOR_WORDS = ("token", "secret", "password", "passwd", "passphrase", "pwd", "apikey", "api_key", "api-key", "auth", "authorization", "bearer", "credential", "credentials", "private", "access_key", "access-key", "client_secret", "key")
AGAINST_WORDS = ("sha", "sha1", "sha256", "md5", "checksum", "hash", "digest", "commit", "revision", "integrity", "uuid", "guid", "etag", "id", "version", "build", "example", "sample", "test", "fixture", "phone", "card", "order", "invoice", "serial", "isbn")
# Places where findings are seldom real.
AGAINST_PATHS = ("test", "tests", "spec", "example", "examples", "sample", "fixture", "fixtures", "mock", "docs", "lock", "snapshot", "vendor", "node_modules")
# Starts of tokens that issuers define.
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "sk-", "sk_live_", "rk_live_", "xoxb-", "xoxp-", "AIza", "eyJ", "SG.", "npm_", "pypi-", "hf_", "-----BEGIN")
# The dictionary: words that stand in names, not in keys.
DICTIONARY = (
    "access account action active address admin agent alert alias amount answer apple application array article asset audio author average back balance base batch before begin best binary black block board body book border bottom branch bridge broken browser buffer build button cache call cancel card category center chain change channel chapter character chart check child city class clean clear click client clock close cloud code color column comment common company compare compile complete config connect console contact content context control copy count country course cover create current custom cycle data database date debug default delete deploy design detail device dialog direct disable display docs document domain down draft driver dummy edit element email empty enable engine entry error event example export extra factory failed feature field file filter final find first fixture flag flow folder font force format forward frame from front function future gate general global good graph great green group guide handle hash header health hello help hidden high history home host image import index info inner input insert install instance item join jump keyboard label language large last layer layout level library license light limit line link list load local lock login long loop lower mail main manager manual map master match matrix media member memory menu message meta method metric middle minimum mirror missing mobile model module month mouse name native network next node normal note number object offset online open option order origin other output owner package page panel parent part pass path pattern payload phone picture pixel place placeholder plain player plugin point policy port position post power prefix price primary print process product profile project property proxy public query queue quick random range rate read record reference region release remote remove render report request reset resource response result return review right role root route rule sample save scale schema scope score screen script search second section select sequence server service session setting shape share short show side simple single site size slow small snapshot social sort source space special stack stage start state status step stop storage store stream string style submit success switch symbol system table target task template test text theme thread time title tool total track transfer tree type union unique unit update upload user valid value vector version video view visible warning watch website width window word world write your"
).split()

FEATURES = ("length", "log_length", "lower_digit", "digit_lower", "upper_lower", "lower_upper", "digit_digit", "letter_letter", "other", "vowels", "hex", "distinct", "repeats", "digits", "symbols", "dots", "plain", "code", "covered", "prefix", "bad_path", "for_near", "against_near", "assigned", "quoted")


def _list(words: tuple) -> str:
    return "|".join(w.replace("-", r"\-").replace(".", r"\.") for w in sorted(words, key=len, reverse=True))


def _share(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)) / F.length(text)


def with_features(found: DataFrame) -> DataFrame:
    """Adds ``FEATURES`` to rows of (candidate, path, before, after); nulls count as empty."""
    c, path, before, after = (F.coalesce(F.col(x), F.lit("")) for x in ("candidate", "path", "before", "after"))
    c = F.when(F.length(c) > 0, c).otherwise(F.lit("-"))
    chars = F.array_distinct(F.split(c, ""))
    last_words = F.lower(before)
    columns = {
        "length": F.length(c).cast("double"),
        "log_length": F.log1p(F.length(c)),
        # Character transitions.
        "lower_digit": _share(c, "[a-z](?=[0-9])"),
        "digit_lower": _share(c, "[0-9](?=[a-z])"),
        "upper_lower": _share(c, "[A-Z](?=[a-z])"),
        "lower_upper": _share(c, "[a-z](?=[A-Z])"),
        "digit_digit": _share(c, "[0-9](?=[0-9])"),
        "letter_letter": _share(c, "[A-Za-z](?=[A-Za-z])"),
        "other": _share(c, "[_+/=-]"),
        "vowels": _share(c, "(?i)[aeiou]"),
        "hex": F.col("candidate").rlike("^[0-9a-fA-F]+$").cast("double"),
        "distinct": F.size(chars) / F.least(F.length(c), F.lit(64)),
        "repeats": _share(c, r"(.)(?=\1)"),
        "digits": _share(c, "[0-9]"),
        "symbols": _share(c, "[^A-Za-z0-9_+/=. -]"),
        "dots": _share(c, r"[./]"),
        "plain": c.rlike("^[A-Za-z]?[a-z]+$|^[A-Z]+$").cast("double"),
        # Calls, variables, placeholders and markup.
        "code": c.rlike(r"[(){}<>\[\]$]|^[*xX.#]+$|::|->").cast("double"),
        # Dictionary coverage.
        "covered": 1 - F.length(F.regexp_replace(F.lower(c), F.lit(_list(tuple(DICTIONARY))), F.lit(""))) / F.length(c),
        "prefix": c.rlike("^(" + _list(PREFIXES) + ")").cast("double"),
        # Path and neighbouring words.
        "bad_path": F.lower(path).rlike("(^|[^a-z])(" + _list(AGAINST_PATHS) + ")([^a-z]|$)").cast("double"),
        "for_near": last_words.rlike("(^|[^a-z])(" + _list(FOR_WORDS) + ")[^a-z]*$").cast("double"),
        "against_near": last_words.rlike("(^|[^a-z])(" + _list(AGAINST_WORDS) + ")[^a-z]*$").cast("double"),
        "assigned": before.rlike(r"[=:]\s*[\"'`]?$").cast("double"),
        "quoted": (before.rlike("[\"'`]$") & after.rlike("^[\"'`]")).cast("double"),
    }
    return found.select("*", *[F.coalesce(v.cast("double"), F.lit(0.0)).alias(f"f_{k}") for k, v in columns.items()])


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None) -> DataFrame:
    """(id, ordinal, candidate, path, before, after): each candidate with the text around it; ordinal counts from 0 in a text.

    Of a value that a name, or a URL, points at, the candidate is the value; name and URL belong to the text before.
    """
    rows = docs.select(F.col(id_col).alias("id"), (F.col(path_col).cast("string") if path_col else F.lit(None).cast("string")).alias("path"), F.col(text_col).alias("text")).filter(F.col("text").rlike(CANDIDATE))
    pieces = rows.select("id", "path", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("found"), F.split("text", CANDIDATE, -1).alias("gaps"))
    around = pieces.select("id", "path", F.transform("gaps", lambda g: F.struct(F.right(g, F.lit(BEFORE)).alias("end"), F.left(g, F.lit(AFTER)).alias("start"))).alias("gaps"), "found")
    each = around.select("id", "path", "gaps", F.posexplode("found").alias("ordinal", "found"))
    led = each.withColumn("lead", F.regexp_extract("found", LEAD, 0))
    value = F.substr("found", F.length("lead") + 1)
    before = F.right(F.concat(F.get("gaps", F.col("ordinal"))["end"], "lead"), F.lit(BEFORE))
    return led.select("id", "ordinal", value.alias("candidate"), "path", before.alias("before"), F.get("gaps", F.col("ordinal") + 1)["start"].alias("after"))


def labelled_findings(spark: SparkSession, each: int = 120) -> DataFrame:
    """(candidate, path, before, after, label): made findings of kinds that reviewers label, ``each`` rows a kind, from hashes of their numbers.

    They stand in for labelled findings of one's own, which :func:`train` takes.
    """
    n = F.col("id").cast("string")
    hexes = lambda salt, size: F.substring(F.sha2(F.concat(F.lit(salt), n), 512), 1, size)
    mixed = lambda salt, size: F.substring(F.regexp_replace(F.base64(F.unhex(F.sha2(F.concat(F.lit(salt), n), 512))), "[+/=]", "x"), 1, size)
    pick = lambda values, salt="": F.element_at(F.array(*[F.lit(v) for v in values]), F.pmod(F.xxhash64(n, F.lit(salt)), F.lit(len(values))).cast("int") + 1)
    size = lambda low, high, salt: (F.pmod(F.xxhash64(n, F.lit(salt)), F.lit(high - low + 1)) + low).cast("int")
    words = lambda k: F.concat_ws("_", *[pick(DICTIONARY, f"w{i}") for i in range(k)])
    good = ("token", "secret", "password", "api_key", "auth_token", "client_secret", "AWS_SECRET_ACCESS_KEY", "private_key", "credentials", "DB_PASSWORD")
    bad = ("sha256", "commit", "checksum", "md5", "integrity", "etag", "build id", "uuid", "revision", "digest")
    nouns = ("item", "name", "the", "of", "and", "see", "use", "from", "row", "with", "title", "heading")
    paths = (None, None, "src/app/settings.py", "config/prod.yaml", "deploy/env", "https://host.example/page", "lib/client.rb")
    tests = ("tests/fixtures/data.json", "docs/example.md", "package-lock.json", "spec/mock.rb", "vendor/module.js")
    before = lambda names, ends: F.concat(pick(("text and ", "foo ", "the value of ", "", "export "), "l"), pick(names, "n"), pick(ends, "e"))
    assigned, plain = (' = "', ": '", "=", ': "', " = ", '": "'), (" ", ": ", " is ", " (")
    mark = lambda salt: pick(("!", "@", "#", "%", "&", "*", "^", "?", "+", "_"), salt)
    word = lambda salt: pick(tuple(DICTIONARY), salt)
    leet = F.concat(F.initcap(F.translate(word("x"), "aeio", "4310")), mark("m"), F.translate(word("y"), "aes", "@3$"), F.pmod(F.xxhash64(n), F.lit(100)).cast("string"))
    kinds = [
        (hexes("a", 40), paths, before(good, assigned), 1),
        (F.substring(hexes("b", 64), F.lit(1), size(24, 64, "s")), paths, before(good, assigned), 1),
        (F.substring(mixed("c", 64), F.lit(1), size(20, 64, "t")), paths, before(good, assigned), 1),
        (F.concat(pick(PREFIXES[:-1], "p"), mixed("d", 36)), paths, before(("", "use ", "key ", "login with "), (' "', " ", "=")), 1),
        (F.concat(pick(("AKIA", "ASIA"), "p"), F.upper(mixed("q", 16))), paths, before(("", "use ", "key ", "id "), (' "', " ", "=", ": ")), 1),
        (mixed("e", 40), paths, before(("password", "bearer", "authorization"), (": ", " ", "=")), 1),
        # Passwords: with marks, of words with changed letters, of letters alone.
        (F.concat(F.substring(mixed("r", 64), F.lit(1), size(3, 9, "u")), mark("a"), F.substring(mixed("s", 64), F.lit(1), size(3, 9, "v")), mark("b")), paths, before(("password", "passwd", "pwd", "DB_PASSWORD", "secret", "passphrase"), assigned), 1),
        (leet, paths, before(("password", "passwd", "pwd", "DB_PASSWORD", "secret"), assigned), 1),
        (F.translate(F.substring(mixed("v", 64), F.lit(1), size(10, 24, "w")), "0123456789", "gHjKmNpQrS"), paths, before(("password", "passwd", "secret", "api_key"), assigned), 1),
        (F.concat(F.substring(mixed("w", 64), F.lit(1), size(3, 7, "x")), mark("c"), F.substring(mixed("x", 64), F.lit(1), size(2, 6, "y"))), paths, F.concat(pick(("postgres", "mysql", "amqp", "https", "redis"), "s"), F.lit("://"), word("z"), F.lit(":")), 1),
        # Tokens of several parts, and heads of private keys.
        (F.concat(F.lit("SG."), mixed("y", 22), F.lit("."), mixed("z", 43)), paths, before(("key", "use", "send with", "api_key"), (" ", "=", ': "')), 1),
        (F.concat(F.lit("eyJ"), mixed("A", 20), F.lit(".eyJ"), mixed("B", 40), F.lit("."), mixed("C", 43)), paths, before(("authorization: bearer", "token", "cookie"), (" ", "=", ': "')), 1),
        (F.concat(F.lit("-----BEGIN "), pick(("RSA ", "EC ", "OPENSSH ", "", "ENCRYPTED "), "k"), F.lit("PRIVATE KEY-----")), paths, pick(("", "\n", 'key = "', "cert: ", " "), "b"), 1),
        (hexes("f", 40), paths, before(bad, assigned + plain), 0),
        (hexes("g", 64), tests, before(bad, assigned + plain), 0),
        (F.concat_ws("-", hexes("h", 8), hexes("i", 4), hexes("j", 4), hexes("k", 4), hexes("l", 12)), paths, before(bad + nouns, assigned + plain), 0),
        (F.concat(words(3), F.lit("_"), (F.pmod(F.xxhash64(n), F.lit(1000))).cast("string")), paths, before(good + bad + nouns, assigned + plain), 0),
        (F.translate(hexes("m", 16), "abcdef", "012345"), paths, before(("call", "phone", "card", "order", "invoice", *nouns), plain), 0),
        (F.concat(words(2), F.lit("/"), words(2), F.lit("/v"), (F.pmod(F.xxhash64(n), F.lit(20))).cast("string")), paths, before(("see", "path", "open", "at"), plain), 0),
        (F.concat(F.repeat(pick(("x", "0", "1", "X", "ab", "123", "*", "."), "r"), size(8, 30, "u")), pick(("0", "", "x"), "z")), paths, before(good, assigned), 0),
        (F.concat(F.lit("your_"), words(2), pick(("_here_1", "_here", "", "123"), "h")), tests + paths, before(good, assigned), 0),
        (hexes("o", 40), tests, before(("example token", "sample key", "dummy secret", "test password"), assigned), 0),
        (F.concat(word("q"), words(3), F.lit("2")), paths, before(nouns, plain), 0),
        # What programs and prose put after such names: words, calls, variables, paths, types, markup.
        (F.concat(word("a"), pick(("", "s", "ed", "ing", "d"), "b")), paths, before(("password", "token", "secret", "credentials", "the token", "api_key"), assigned + (": ", " = ")), 0),
        (F.concat(words(2), pick(("()", "();", "(self)", "(config)", "[0]"), "b")), paths, before(good, (" = ", "=", ": ")), 0),
        (F.concat(pick(("${", "{{", "<", "$(", "process.env.", "os.environ[", "%("), "b"), F.upper(words(2)), pick(("}", "}}", ">", ")", "]", ""), "c")), paths, before(good, assigned), 0),
        (F.concat_ws(".", word("a"), word("b"), word("c"), pick(("token", "v2", "key", "html", "py"), "d")), paths, before(good + nouns, assigned + plain), 0),
        (F.concat(F.lit("www."), word("a"), F.lit(".example.com/"), words(2), F.lit("/page"), F.pmod(F.xxhash64(n), F.lit(99)).cast("string")), paths, before(nouns, plain), 0),
        (F.concat(pick(("changeme", "password", "example", "placeholder", "required", "optional", "undefined", "required|string", "string", "nullable", "redacted"), "a"), pick(("", "", "!", "1"), "b")), paths, before(good, assigned), 0),
    ]
    made = [spark.range(each).select(c.alias("candidate"), pick(p, "path").alias("path"), b.alias("before"), pick(('"', "'", " ", "\n", ""), "z").alias("after"), F.lit(float(label)).alias("label")) for c, p, b, label in kinds]
    return reduce(DataFrame.union, made)


def train(labelled: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> PipelineModel:
    """A random forest over ``FEATURES`` from labelled findings (candidate, path, before, after, label 0 or 1)."""
    columns = [f"f_{f}" for f in FEATURES]
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed, minInstancesPerNode=3)
    # One partition: the bootstrap then depends on the seed alone.
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="features"), forest]).fit(with_features(labelled.filter("label is not null")).coalesce(1))


def scan(docs: DataFrame, model: PipelineModel, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(id, ordinal, candidate, before, after, score, is_secret): one row for each candidate of each text.

    score is the forest's probability, is_secret whether it reaches ``threshold``. Null and empty texts have no
    candidates, null paths count as unknown, repeated rows give repeated candidates, an empty table gives no rows.
    A run of key characters is one candidate, however long it is; so is an unquoted value.
    """
    scored = model.transform(with_features(candidates(docs, id_col, text_col, path_col)))
    probability = F.round(vector_to_array("probability")[1], 6)
    return scored.select(F.col("id").alias(id_col), "ordinal", "candidate", "before", "after", probability.alias("score"), (probability >= threshold).alias("is_secret"))

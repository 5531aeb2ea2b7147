"""Secret scanning with a random forest that sorts out false findings.

Candidates are long runs of token characters with a digit in them, dotted tokens, every quoted or assigned value beside a word that
speaks of secrets, and passwords in addresses; of the latter two neither length nor alphabet decide.  The forest looks at a candidate's length, its
transitions between kinds of character, how much of it a dictionary and common letter pairs cover, the path it stands
under, and the words beside it; it is trained from labelled findings.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.spans import matches, row_key
from spanloom.shared import written

LEAST_CHARS = 16
TREES, DEPTH, SEED = 32, 9, 11
SECRET_FROM = 0.5  #: probability from which a finding counts as a secret
CONTEXT = 40  #: characters looked at on either side
_SET = "A-Za-z0-9_+/-"
# Words beside a secret, words beside things that look like one, paths that hold samples, frequent letter pairs, a dictionary of plain words.
SECRET_WORDS = "token|secret|passw|pwd|api.?key|apikey|access.?key|private.?key|credential|auth|bearer|client.?id|signature|session"
OTHER_WORDS = "uuid|guid|commit|sha|md5|checksum|digest|version|serial|order|isbn|phone|card|account|example|sample|dummy|placeholder|test"
_NAME = rf"(?i:{SECRET_WORDS})[A-Za-z0-9_.-]{{0,16}}"
_MARKED = "(?<=[=:\"'` \t])(?<![^=:> \t][ \t])"  #: implied by _ASSIGNED, and turns most places down at once
_ASSIGNED = _MARKED + rf"(?<=[=:\"'`]|[=:>][ \t]|[=:>][ \t]{{2}})(?<={_NAME}[\"'`\]]{{0,2}}[ \t]{{0,2}}[=:]{{0,2}}>?[ \t]{{0,2}}[\"'`]?)"
_QUOTED = "(?<=[\"'`])[^\\s\"'`][^\\n\"'`]{0,200}+(?=[\"'`])"
_BARE = "(?<![\"'`])[^\\s\"'`<>=:][^\\s\"'`<>]{0,400}(?<![,;.)}\\]])"
_ADDRESS = r"(?<=:)(?<=://[^\s:@/]{0,40}:)[^\s@/]{1,200}+(?=@)"
_RUN = rf"(?<![{_SET}])(?=[A-Za-z_+/-]*+[0-9])[{_SET}]{{{LEAST_CHARS},}}+(?:={{1,2}}(?![{_SET}=]))?"
_DOTTED = r"(?=[eS][yG])(?<![A-Za-z0-9_-])(?:eyJ[A-Za-z0-9_-]{8,}+|SG)\.[A-Za-z0-9_-]{8,}+(?:\.[A-Za-z0-9_-]*+)?"
CANDIDATE = rf"{_ADDRESS}|{_ASSIGNED}(?:{_QUOTED}|{_BARE})|{_DOTTED}|{_RUN}"
SAMPLE_PATHS = "test|spec|example|sample|fixture|mock|doc"
LETTER_PAIRS = "th|he|in|er|an|re|on|at|en|nd|ti|es|or|te|of|ed|is|it|al|ar|st|to|nt|ng|se|ha|as|ou|io|le|ve|co|me|de|hi|ri|ro|ic|ne|ea|ra|ce|li|ch|ll|be|ma|si|om|ur"
WORDS = "about|access|account|address|admin|after|answer|apple|article|battery|before|between|black|blue|board|book|border|build|button|cache|change|client|cloud|code|color|column|company|config|content|control|correct|count|country|create|data|date|default|document|dragon|email|error|event|example|false|family|field|file|filter|final|first|flower|folder|form|forest|garden|global|group|handler|header|history|horse|house|image|index|input|international|internal|item|label|letter|level|light|list|local|long|magic|main|manager|market|member|menu|message|method|model|module|money|monkey|morning|name|network|object|office|open|option|orange|order|output|page|parent|party|person|plain|point|policy|power|process|product|profile|project|public|queue|reader|record|region|release|report|request|response|result|return|rule|sample|school|screen|search|second|select|server|service|setting|simple|small|source|space|staple|start|state|status|step|stone|store|stream|string|style|summer|system|table|task|team|text|time|title|total|tree|type|under|union|update|user|value|version|view|water|window|winter|word|work|world|write|year|young"


def candidates(files: DataFrame) -> DataFrame:
    """(key, path, value, start, stop, before, after): every candidate of every whole text, places in code points.

    files: ``key``, ``path`` and ``text``; further columns are ignored; a null or empty text has no candidates.
    """
    held = files.where(F.col("text").rlike(CANDIDATE)).select("key", "path", F.explode(matches(F.col("text"), CANDIDATE, CONTEXT)).alias("m"))
    return held.select("key", "path", "m.value", "m.start", "m.stop", "m.before", "m.after")


def _left(value: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(value, pattern, "")).cast("double")


def features(found: DataFrame) -> tuple[DataFrame, list[str]]:
    """Numeric features of findings."""
    value, n = F.col("value"), F.length("value").cast("double")
    near = F.lower(F.regexp_extract(F.coalesce("before", F.lit("")), r"[^\n]{0,24}$", 0))
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[a-z]+", "l"), "[A-Z]+", "u"), "[0-9]+", "d")
    columns = {
        "f_length": n,
        "f_digits": (n - _left(value, "[0-9]")) / n,
        "f_upper": (n - _left(value, "[A-Z]")) / n,
        "f_signs": (n - _left(value, "[^A-Za-z0-9]")) / n,
        "f_runs": F.length(kinds).cast("double") / n,
        "f_hex": (n - _left(value, "[0-9a-fA-F]")) / n,
        "f_distinct": F.size(F.array_distinct(F.split(value, ""))).cast("double") / F.least(n, F.lit(40.0)),
        "f_repeat": (n - _left(value, r"(.)\1+")) / n,
        "f_pairs": (n - _left(F.lower(value), LETTER_PAIRS)) / n,
        "f_words": (n - _left(F.lower(value), WORDS)) / n,
        "f_secret_word": near.rlike(SECRET_WORDS).cast("double"),
        "f_other_word": near.rlike(OTHER_WORDS).cast("double"),
        "f_assigned": near.rlike(r"[=:]\s*[\"'`]?$").cast("double"),
        "f_quoted": (F.coalesce("before", F.lit("")).rlike("[\"'`]$") & F.coalesce("after", F.lit("")).rlike("^[\"'`]")).cast("double"),
        "f_groups": value.rlike(r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$").cast("double"),
        "f_address": F.coalesce("before", F.lit("")).rlike(r"://[^\s:@/]*:$").cast("double"),
        "f_plain": value.rlike(r"^[A-Za-z]?[a-z\u00df-\u00ff]*[.,;:!?]*$|^[A-Z_]+$| ").cast("double"),
        "f_reference": value.rlike(r"^[$<{%(\[*]|^[A-Za-z_]+[.(\[][A-Za-z_]").cast("double"),
        "f_sample_path": F.lower(F.coalesce("path", F.lit(""))).rlike(SAMPLE_PATHS).cast("double"),
    }
    return found.withColumns(columns), list(columns)


def labelled_findings(spark: SparkSession, rows: int = 9000) -> DataFrame:
    """Findings with labels by construction, half of them secrets.

    Secrets have the shapes that issuers publish for their tokens, or those of keys and passwords that people choose;
    the others are names, words, numbers, digests, times and references.  Both stand beside the same words and marks,
    so that neither shape nor neighbourhood decides alone; digests are secrets only where words say so.
    """
    i = F.col("id")

    def pick(seed: int, *options) -> Column:
        values = [F.lit(o) if isinstance(o, str) else o for o in options]
        return F.element_at(F.array(*values), (F.pmod(F.xxhash64(F.lit(seed), i), F.lit(len(values))) + 1).cast("int"))

    share = lambda seed, percent: F.pmod(F.xxhash64(F.lit(seed), i), F.lit(100)) < percent
    text = i.cast("string")
    digest = F.concat(F.sha2(text, 512), F.sha2(F.concat(text, F.lit("+")), 512))
    coded = F.regexp_replace(F.concat(*(F.base64(F.unhex(F.sha2(F.concat(F.lit(str(k)), text), 512))) for k in range(2))), "[+/=]", "")
    digits = F.regexp_replace(digest, "[^0-9]", "")
    letters = F.regexp_replace(coded, "[0-9]", "")
    n_words = len(WORDS.split("|"))
    picked = lambda seed: F.element_at(F.split(F.lit(WORDS), r"\|"), (F.pmod(F.xxhash64(F.lit(seed), i), F.lit(n_words)) + 1).cast("int"))
    parts = {"digest": digest, "coded": coded, "digits": digits, "letters": letters} | {f"w{k}": picked(k) for k in (5, 6, 7, 8, 10, 11, 12, 14, 15)}
    held = written(spark.range(rows).select("id", *(c.alias(n) for n, c in parts.items())), "finding-parts")  # used many times: a short plan
    digest, coded, digits, letters = map(F.col, ("digest", "coded", "digits", "letters"))
    word = lambda seed: F.col(f"w{seed}")
    cut = F.substring
    uuid = F.concat_ws("-", cut(digest, 1, 8), cut(digest, 9, 4), cut(digest, 13, 4), cut(digest, 17, 4), cut(digest, 21, 12))
    issued = pick(
        1, F.concat(F.lit("ghp_"), cut(coded, 1, 36)), F.concat(F.lit("github_pat_"), cut(coded, 1, 22), F.lit("_"), cut(coded, 30, 59)), F.concat(F.lit("glpat-"), cut(coded, 1, 20)),
        F.concat_ws("-", F.lit("xoxb"), cut(digits, 1, 12), cut(digits, 13, 12), cut(coded, 1, 24)), F.concat(F.lit("sk_live_"), cut(coded, 1, 24)), F.concat(F.lit("sk-"), cut(coded, 1, 48)),
        F.concat(F.lit("AKIA"), F.upper(cut(digest, 1, 16))), F.concat(F.lit("AIza"), cut(coded, 1, 35)), F.concat(F.lit("npm_"), cut(coded, 1, 36)), F.concat(F.lit("SG."), cut(coded, 1, 22), F.lit("."), cut(coded, 23, 43)),
        F.concat(F.lit("eyJhbGciOiJIUzI1NiJ9.eyJ"), cut(coded, 1, 60), F.lit("."), cut(coded, 61, 43)), F.concat(F.lit("hf_"), cut(letters, 1, 34)), cut(coded, 1, 40), F.concat(cut(coded, 1, 20), F.lit("/"), cut(coded, 21, 19), F.lit("+"), cut(coded, 41, 3)),
    )
    keys = pick(2, cut(digest, 1, 32), cut(digest, 1, 40), cut(digest, 1, 64), cut(coded, 1, 24), F.concat(cut(coded, 1, 43), F.lit("=")))
    passwords = pick(
        3, F.concat(cut(coded, 1, 5), pick(4, "&", "!", "#", "@"), cut(digits, 1, 2), cut(letters, 1, 3)), F.concat(word(5), cut(digits, 1, 2), word(6)), F.concat(F.initcap(word(5)), F.initcap(word(6)), F.initcap(word(7)), F.initcap(word(8))),
        F.concat(F.lit("p@ss"), cut(letters, 1, 3), cut(digits, 1, 2)), cut(letters, 1, 20), cut(letters, 1, 12), F.concat(word(5), cut(digits, 1, 3), F.lit("!")), F.concat(cut(letters, 1, 3), F.lit("S3cr"), cut(coded, 1, 5)), F.concat(cut(coded, 1, 5), F.lit("!"), cut(digits, 1, 4), F.lit("#"), cut(letters, 1, 3)),
        F.concat(F.translate(word(5), "aeos", "@30$"), pick(4, "&", "!", "#", "@"), cut(digits, 1, 4), pick(33, "#", "-", "."), word(6)),
    )
    names = pick(
        9, F.concat_ws("_", word(10), word(11), word(12), cut(digits, 1, 1)), F.concat(word(10), F.initcap(word(11)), F.initcap(word(12)), cut(digits, 1, 2)), F.concat_ws("-", word(10), word(11), word(12), F.concat(F.lit("v"), cut(digits, 1, 1))), F.upper(F.concat_ws("_", word(10), word(11), F.lit("ID"), cut(digits, 1, 1))),
        F.concat_ws("/", word(10), word(11), F.concat(word(12), cut(digits, 1, 2))), F.concat(F.repeat(F.lit("x"), 16), cut(digits, 1, 1)), F.concat(F.lit("2024-01-01T00-00-"), cut(digits, 1, 2)), cut(digits, 1, 16), F.concat(cut(digits, 1, 16), F.lit("=="), cut(digits, 17, 16)), F.concat(word(10), word(11), word(12), cut(digits, 1, 3)),
    )
    plain = pick(
        13, word(14), F.initcap(word(14)), F.concat(F.lit("${"), F.upper(word(14)), F.lit("}")), F.concat(F.lit("<"), word(14), F.lit(">")), F.concat(F.lit("os.getenv("), word(14), F.lit(")")), F.concat_ws(" ", word(14), word(15)), F.lit("********"), F.lit("null"), F.lit("None"), F.lit("true"), F.lit("required"),
        F.concat(word(14), pick(16, ".", ",", "!")),
    )
    secret_place = pick(20, 'token = "', "api_key: ", "password='", "SECRET=", "Authorization: Bearer ", 'access_key = "', "client secret ", 'auth_token="', "passwd: ", 'password = "', "password: ", 'secret="', "api_key=")
    other_place = pick(21, "the order of ", "commit ", "sha1 checksum ", "version ", "and the ", "account ", "build ", "uuid = ", "pay ", "see ")
    bare_place = pick(22, "GITHUB=", "export X=", "value: ", 'key = "', "use ", "curl -H ", "id=")
    address = pick(23, "postgres://user:", "https://admin:", "amqp://job:")
    filler = pick(24, "now the server ", "as said ", "in this case ", "mail6.example.com ", "# ", "")
    role = F.pmod(F.xxhash64(F.lit(25), i), F.lit(20))  # which kind of finding, in twentieths
    value = F.when(role < 4, issued).when(role < 6, keys).when(role < 9, passwords).when(role < 10, passwords).when(role < 14, names).when(role < 18, plain).when(role < 19, pick(26, cut(digest, 1, 40), cut(digest, 1, 32), uuid, cut(digest, 1, 64))).otherwise(pick(27, uuid, cut(digits, 1, 16)))
    place = F.when(role < 4, F.when(share(28, 50), secret_place).otherwise(bare_place)).when(role < 9, secret_place).when(role < 10, address).when(role < 14, F.when(share(29, 40), secret_place).when(share(30, 50), bare_place).otherwise(other_place)).when(role < 18, secret_place).otherwise(other_place)
    quote = F.regexp_extract(place, "([\"'])$", 1)
    after = F.when(role == 9, "@host/base").otherwise(F.concat(quote, pick(31, " then", "", ", and so", "\n")))
    return held.select(value.alias("value"), F.concat(filler, place).alias("before"), after.alias("after"), pick(32, "src/main/app", "config/prod", "web/page", "tests/unit", "notes").alias("path"), (role < 10).cast("double").alias("label"))


def train(labelled: DataFrame) -> PipelineModel:
    """A forest from labelled findings: value, before, after, path and label (1 secret, 0 not); rows with nulls in value or label are left out."""
    rows, names = features(labelled.where("value IS NOT NULL AND value != '' AND label IS NOT NULL"))
    rows = written(rows.select("label", *names), "labelled-features")  # the forest reads them several times
    assembler = VectorAssembler(inputCols=names, outputCol="features")
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt")
    return PipelineModel([assembler, forest.fit(assembler.transform(rows))])


def scan(files: DataFrame, model: PipelineModel) -> DataFrame:
    """Every candidate with its probability: key, path, value, start, stop, score (6 decimals) and is_secret."""
    rows, names = features(candidates(files))
    scored = model.transform(rows.select("key", "path", "value", "start", "stop", *names))
    score = F.round(vector_to_array("probability")[1], 6)
    return scored.select("key", "path", "value", "start", "stop", score.alias("score"), (score >= SECRET_FROM).alias("is_secret"))


def redact(documents: DataFrame, model: PipelineModel, mask: str = "[SECRET]", path: Column | None = None) -> DataFrame:
    """The documents, all columns, with every secret in ``text`` replaced by ``mask``; ``n_chars`` follows where there is one.

    Rows are matched to their findings by id and text, so repeated rows are redacted alike.
    """
    own = row_key(F.col("doc_id"), F.col("text"))
    where = F.lit("") if path is None else path
    files = documents.select(own.alias("key"), where.alias("path"), "text").where(F.col("text").rlike(CANDIDATE)).dropDuplicates(["key"])
    secrets = scan(files, model).where("is_secret").groupBy("key").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("_spans"))
    rows = documents.withColumn("_key", own).join(secrets.withColumnRenamed("key", "_key"), "_key", "left")
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda s, x: F.struct(x["stop"].alias("at"), F.concat(s["out"], F.substring(F.col("text"), s["at"] + 1, x["start"] - s["at"]), F.lit(mask)).alias("out"))
    clean = F.aggregate("_spans", begin, step, lambda s: F.concat(s["out"], F.substring(F.col("text"), s["at"] + 1, F.length("text"))))
    text = F.when(F.col("_spans").isNull(), F.col("text")).otherwise(clean)
    grown = F.aggregate("_spans", F.lit(0), lambda s, x: s + len(mask) - (x["stop"] - x["start"]))
    n_chars = F.when(F.col("_spans").isNull(), F.col("n_chars")).otherwise((F.length("text") + grown).cast("long")) if "n_chars" in documents.columns else None
    columns = [text.alias("text") if c == "text" else n_chars.alias("n_chars") if c == "n_chars" else F.col(f"`{c}`") for c in documents.columns]
    return rows.select(*columns)

"""Operator 6, secret scans, native: candidates by pattern, false positives removed by a random forest.

DataFrame functions only. A pattern finds candidates (long runs of key-like characters with a digit, and
values of six or more of any characters that are assigned or quoted after a secret word); splitting the
text at the same pattern gives the text on either side of each. Features are columns: length and character make-up, transitions between character classes, how much of the candidate words of
a dictionary cover, path-like surroundings, and neighbouring words. The forest is trained on labelled
findings (a bounded table, made from a rule if none is given) and scores every candidate where it lies;
no row is shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import one_column, own_columns, stash, text_or_empty

#: Fixed values. A long run of key-like characters with a digit.
RUN = r"(?<![A-Za-z0-9+/_.-])(?=[A-Za-z+/_.-]*[0-9])[A-Za-z0-9+/_.-]{16,}={0,2}"
#: What leads to a value: a secret word, the rest of its name, a sign, a quote. Java looks back over bounded lengths only.
NAME = r"(?i:secret|token|passw|pwd|api[_-]?key|access[_-]?key|auth|credential|private|bearer|client[_-]?key)[A-Za-z0-9_-]{0,12}[\"'`]?"
SIGN = r"\s{0,2}(?::=|=>|[=:])\s{0,2}"
#: A value of six or more of any characters, in quotes or up to white space; closing marks at its end are not of it.
#: The cheap look back for a sign comes before the one for the whole name, which most words then never reach.
QUOTED = "|".join(rf"(?<={q})(?<={NAME}(?:{SIGN}|\s{{1,2}}){q})[^{q}\n]{{6,}}(?={q})" for q in "\"'`")
ASSIGNED = rf"(?<=[=:>]\s{{0,2}})(?<={NAME}{SIGN})[^\s\"'`,;<>=][^\s\"'`,;<>]{{4,}}(?<![.)\]}}])"
CANDIDATE = f"{QUOTED}|{ASSIGNED}|{RUN}"
#: Characters of text that are looked at on either side of a candidate.
NEAR = 48
#: Words of the dictionary, of secrets' neighbourhoods and of harmless ones.
DICTIONARY = (
    "about access account address after apple application archive article asset audio author backup banner before bench "
    "branch browser bucket build button cache camera center change channel class client cloud code color column commit "
    "common compile config content context control cookie core count cover crypto data debug default delete deploy detail "
    "device direct docker domain download driver edit email engine entry error event example export factory feature field "
    "file filter final fixture folder font form format frame from function gallery general graph group guide handler header "
    "health height home host icon image import index input install integration item java kernel label language layout "
    "level library light line linux list load local locale login main manager manual master media member menu message "
    "method mobile mock model module monitor mount move music name native network news node note number object offset "
    "open option order output package page panel param parent parser patch path pattern photo plan player plugin point "
    "policy post power preview print process product profile project proxy public query queue random range read record "
    "region register release remote render report request reset resource response result role root route router rule sample "
    "scale schedule schema score screen script search section security select send sensor server service session setting "
    "shape share shell shop signal simple site size slide social socket sort source space spec stack staff start state static "
    "status step stock storage store stream string style submit summary support switch symbol sync system table target task "
    "team template term test text theme thread thumb time title tool topic total trace track traffic train transfer tree type "
    "unit update upload upper user utility value vector vendor version video view virtual visit visual volume watch water wave "
    "weather web week widget width window wire word work worker world wrapper write year zero zone zoom"
).split()
#: Words outside the dictionary, for harmless findings: identifiers hold names that no list has.
OUTSIDE = (
    "alder banjo cobalt dahlia ermine falcon gravel hazel indigo jasper kestrel lagoon marten nectar obsidian pelican quartz "
    "raven saffron thicket umber velvet walnut xenon yarrow zephyr tundra sorrel harbor bramble"
).split()
SECRET_WORDS = r"(?i)(secret|token|passw|pwd|api[_-]?key|apikey|access[_-]?key|auth|credential|private|bearer|client[_-]?key)"
HARMLESS_WORDS = r"(?i)(sha-?\d*|md5|checksum|digest|commit|revision|uuid|guid|etag|build|version|order|invoice|card|phone|isbn|id|test|example|sample|dummy|placeholder)\W*$"
TEST_PATH = r"(?i)(^|[/_.-])(tests?|spec|examples?|fixtures?|mocks?|docs?|samples?|vendor|node_modules)([/_.-]|$)"
KNOWN_PREFIX = r"^(AKIA|ASIA|ghp_|gho_|ghs_|glpat-|xox[abpr]-|sk_live_|sk-|AIza|eyJ|ya29\.|SG\.|npm_)"
FEATURES = (
    "f_length f_digits f_upper f_lower f_other f_distinct f_transitions f_hex f_prefix f_dictionary f_vowels f_slashes "
    "f_path f_secret_word f_harmless_word f_assigned f_quoted f_word_before f_symbols f_case_turns f_digit_turns f_pairs f_same"
).split()
#: The most frequent pairs of letters in European prose.
PAIRS = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur".split()
#: Labelled findings that the default rule makes.
EXAMPLES = 6000


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", near: int = NEAR) -> DataFrame:
    """doc_id, ordinal (from 1, in the text's order), candidate, before, after (``near`` characters each), path."""
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col in docs.columns else F.lit("")
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"), path.alias("path"))
    found = rows.withColumn("found", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))).where(F.size("found") > 0)
    found = found.withColumn("gaps", F.split("text", CANDIDATE, -1))
    zipped = F.arrays_zip(
        F.col("found").alias("candidate"),
        F.slice("gaps", 1, F.size("found")).alias("before"),
        F.slice("gaps", 2, F.size("found")).alias("after"),
    )
    sides = F.transform(
        zipped,
        lambda x: F.struct(
            x["candidate"].alias("candidate"),
            F.right(x["before"], F.lit(near)).alias("before"),
            F.left(x["after"], F.lit(near)).alias("after"),
        ),
    )
    return found.select("doc_id", "path", F.posexplode(sides)).select(
        "doc_id", (F.col("pos") + 1).alias("ordinal"), "col.*", "path"
    )


def with_features(found: DataFrame) -> DataFrame:
    """Adds FEATURES to rows with candidate, before, after and path."""
    c, n = F.col("candidate"), F.length("candidate").cast("double")
    share = lambda kind: F.length(F.regexp_replace(c, f"[^{kind}]+", "")) / n
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[a-z]+", "a"), "[A-Z]+", "B"), "[0-9]+", "0"), "[^aB0]+", "_")
    letters = F.lower(F.regexp_replace(c, "[^A-Za-z]+", ""))
    covered = F.length(F.regexp_replace(letters, "|".join(sorted(DICTIONARY, key=len, reverse=True)), ""))
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    values = {
        "f_length": F.log1p(n),
        "f_digits": share("0-9"),
        "f_upper": share("A-Z"),
        "f_lower": share("a-z"),
        "f_other": share("+/_.=-"),
        "f_distinct": F.size(F.array_distinct(F.split(c, ""))) / F.least(n, F.lit(256.0)),
        "f_transitions": (F.length(classes) - 1) / n,
        "f_hex": flag(c.rlike("^[0-9a-f]+$")),
        "f_prefix": flag(c.rlike(KNOWN_PREFIX)),
        "f_dictionary": F.coalesce(F.lit(1.0) - F.try_divide(covered.cast("double"), F.length(letters).cast("double")), F.lit(0.0)),
        "f_vowels": F.length(F.regexp_replace(letters, "[^aeiou]+", "")) / n,
        "f_slashes": F.length(F.regexp_replace(c, "[^/.]+", "")) / n,
        "f_path": flag(F.col("path").rlike(TEST_PATH) | F.col("before").rlike(r"[/\\.][A-Za-z0-9_-]*$")),
        "f_secret_word": flag(F.right("before", F.lit(32)).rlike(SECRET_WORDS) | c.rlike("(?i)^[a-z_-]*(secret|token|passw|pwd|key)")),
        "f_harmless_word": flag(F.right("before", F.lit(24)).rlike(HARMLESS_WORDS)),
        "f_assigned": flag(F.col("before").rlike(r"[=:]\s*[\"'`]?$")),
        "f_quoted": flag(F.col("before").rlike("[\"'`]$") & F.col("after").rlike("^[\"'`]")),
        "f_word_before": flag(F.col("before").rlike(r"[A-Za-z]\s+$")),
        # Transitions: between cases, between letters and digits, along frequent pairs of letters, and from a character to itself.
        "f_case_turns": F.size(F.regexp_extract_all(c, F.lit("(?<=[a-z])[A-Z]|(?<=[A-Z])[a-z]"), F.lit(0))) / n,
        "f_digit_turns": F.size(F.regexp_extract_all(c, F.lit("(?<=[A-Za-z])[0-9]|(?<=[0-9])[A-Za-z]"), F.lit(0))) / n,
        "f_pairs": F.coalesce(
            F.try_divide(
                F.size(F.regexp_extract_all(letters, F.lit("(?=(" + "|".join(PAIRS) + "))"), F.lit(1))).cast("double"),
                (F.length(letters) - 1).cast("double"),
            ),
            F.lit(0.0),
        ),
        "f_same": F.size(F.regexp_extract_all(c, F.lit(r"(.)(?=\1)"), F.lit(1))) / n,
        "f_symbols": F.length(F.regexp_replace(c, "[A-Za-z0-9+/_.=-]+", "")) / n,
    }
    return found.withColumns(values)


def example_findings(spark: SparkSession, n: int = EXAMPLES) -> DataFrame:
    """Labelled findings by rule: candidate, before, after, path, label (1 secret). The same on every call."""
    rows = spark.range(0, n, 1, 1)
    h = lambda salt: F.sha2(F.concat_ws("|", F.lit(salt), F.col("id").cast("string")), 512)
    pick = lambda salt, choices: F.element_at(
        F.array(*map(F.lit, choices)), (F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(len(choices))) + 1).cast("int")
    )
    hexes = lambda k, salt="h": F.substring(h(salt), 1, k)
    b64 = lambda k, salt="b": F.substring(F.regexp_replace(F.base64(F.unhex(h(salt))), "[+/=\\s]", "x"), 1, k)
    upper = lambda k: F.substring(F.upper(F.regexp_replace(F.base64(F.unhex(F.concat(h("u"), h("v")))), "[+/=\\s]", "Q")), 1, k)
    digits = lambda k: F.substring(F.translate(h("d"), "abcdef", "123456"), 1, k)
    word, other = pick("w1", DICTIONARY + OUTSIDE * 5), pick("w2", DICTIONARY + OUTSIDE * 5)
    lead = F.concat(word, F.lit(" "), other, F.lit(" "))
    sure = pick("s", ["token", "api_key", "secret", "password", "auth_token", "ACCESS_KEY", "client_secret", "passwd"])
    sign = pick("q", [' = "', '="', ": '", ": ", "=", ' := "'])
    calm = pick("c", ["commit ", "sha256:", "checksum: ", "md5=", "build ", "etag ", "revision ", "uuid "])
    plain = F.concat(F.lit(" "), other)
    clean, tests = pick("p", ["", "src/app", "web", "srv/main"]), pick("t", ["tests/unit", "docs", "examples/a", "src"])
    kinds = [  # candidate, before, after, path, label
        (hexes(40), F.concat(lead, sure, sign), F.lit('" '), clean, 1),
        (F.concat(sure, F.lit("_"), hexes(18)), lead, plain, clean, 1),
        (b64(32), F.concat(lead, sure, sign), F.lit('"'), clean, 1),
        (F.concat(F.lit("AKIA"), upper(16)), lead, plain, clean, 1),
        (F.concat(pick("k", ["ghp_", "glpat-", "sk_live_", "npm_"]), b64(30)), lead, plain, clean, 1),
        (hexes(18), F.concat(lead, pick("s2", ["password=", "pwd=", "passwd: ", "secret="])), plain, clean, 1),
        (F.concat(pick("o", DICTIONARY + OUTSIDE), digits(1), b64(3)), F.concat(lead, sure, sign), plain, clean, 1),
        (F.concat(b64(3), pick("m1", ["@", "!", "#", "$"]), b64(5, "n"), pick("m2", ["!", "%", "&", "*"]), b64(3, "e")), F.concat(lead, sure, sign), plain, clean, 1),
        (F.regexp_replace(b64(20, "l"), "[0-9]", "k"), F.concat(lead, sure, sign), plain, clean, 1),
        (
            F.concat(F.left(word, F.lit(3)), pick("m1", ["@", "!", "#", "$"]), F.left(other, F.lit(4)), pick("m3", [" ", "_", "&", "%"]), hexes(2), pick("m2", ["!", "#", "&", "*"]), digits(1)),
            F.concat(lead, pick("s3", ["pwd", "password", "passwd", "passphrase: secret"]), F.lit(': "')), F.lit('"'), clean, 1,
        ),
        (pick("v", ["required", "optional", "string", "undefined", "enabled", "disabled", "missing", "changeme", "invalid", "expired"]), F.concat(lead, sure, sign), plain, clean, 0),
        (F.concat(word, F.lit("."), other), F.concat(lead, sure, sign), plain, clean, 0),
        (F.concat(word, F.initcap(other), F.lit("(") , pick("w4", OUTSIDE)), F.concat(lead, sure, sign), plain, clean, 0),
        (F.concat(F.lit("${"), F.upper(word), F.lit("_"), F.upper(other)), F.concat(lead, sure, sign), plain, clean, 0),
        (F.concat(F.lit("Enter your "), word, F.lit(" here")), F.concat(lead, sure, F.lit(': "')), F.lit('"'), clean, 0),
        (F.concat(word, F.lit("-"), other, F.lit("-"), pick("w3", DICTIONARY + OUTSIDE * 5), F.lit("-20"), digits(2)), lead, plain, clean, 0),
        (hexes(40), F.concat(lead, calm), plain, clean, 0),
        (hexes(64), F.concat(lead, calm), plain, clean, 0),
        (digits(16), lead, plain, clean, 0),
        (digits(20), lead, plain, clean, 0),
        (
            F.concat_ws("-", F.substring(h("g"), 1, 8), F.substring(h("g"), 9, 4), F.substring(h("g"), 13, 4), F.substring(h("g"), 17, 12)),
            F.concat(lead, pick("i", ["id=", "uuid ", "", "request "])), plain, clean, 0,
        ),
        (F.concat(word, F.lit("/"), other, F.lit("/"), pick("w3", DICTIONARY), digits(2), F.lit(".html")), lead, plain, tests, 0),
        (F.concat(word, F.initcap(other), F.initcap(pick("w3", DICTIONARY)), digits(2)), lead, plain, clean, 0),
        (F.concat(word, F.lit("-"), other, F.lit("-"), digits(1), F.lit("."), digits(2), F.lit(".tar.gz")), lead, plain, tests, 0),
        (F.concat(F.lit("mail"), digits(1), F.lit(".example.com")), F.concat(lead, F.lit("a@")), plain, clean, 0),
        (F.concat(F.lit("xxxxxxxxxxxxxxxx"), digits(2)), F.concat(lead, sure, sign), F.lit('"'), tests, 0),
        (F.concat(F.lit("your-"), word, F.lit("-key-example-"), digits(2)), F.concat(lead, sure, sign), F.lit('"'), tests, 0),
        (F.concat(F.lit("/"), word, F.lit("/"), other, F.lit("/20"), digits(2), F.lit("/"), digits(6)), F.concat(lead, F.lit("http:/")), plain, tests, 0),
    ]
    # Few kinds a plan: a generated method has room for them.
    made, names, few = [], ("candidate", "before", "after", "path", "label"), 7
    for start in range(0, len(kinds), few):
        at = F.col("id") % len(kinds) - start
        part = rows.where(at.between(0, few - 1))
        some = [[x if isinstance(x, Column) else F.lit(x) for x in column] for column in zip(*kinds[start : start + few], strict=True)]
        made.append(part.select(*[reduce(lambda v, k: v.when(at == k, c[k]), range(1, len(c)), F.when(at == 0, c[0])).alias(n) for n, c in zip(names, some, strict=True)]))  # noqa: B023
    return reduce(DataFrame.unionByName, made)


def fit_forest(findings: DataFrame, trees: int = 30, depth: int = 9, seed: int = 5) -> RandomForestClassificationModel:
    """A random forest over FEATURES from rows with candidate, before, after, path and label (0 or 1)."""
    rows = with_features(findings.where("candidate is not null and candidate <> '' and label in (0, 1)").fillna("", ["before", "after", "path"]))
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
    rows = rows.select("features", F.col("label").cast("double").alias("label"))
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="6").fit(rows)


def scan_secrets(
    docs: DataFrame,
    findings: DataFrame | None = None,
    least: float = 0.5,
    id_col: str = "doc_id",
    text_col: str = "text",
    path_col: str | None = "source",
    near: int = NEAR,
    model: RandomForestClassificationModel | None = None,
) -> DataFrame:
    """One row per candidate: doc_id, ordinal, candidate, n_chars, probability, kept (probability >= ``least``).

    ``findings`` are labelled findings (see fit_forest); without them those of a rule are used. ``model`` is a forest that
    was fitted before, and ``near`` how many characters on either side of a candidate count as its neighbours. A text
    that is null or has no candidate gives no row. Identifiers, null and repeated ones too, pass through;
    without the path column paths count as empty. Texts are read whole. An empty table gives an empty
    result.
    """
    # Made findings are stored first: their rule and the features are too much for one generated method.
    model = model or fit_forest(stash(example_findings(docs.sparkSession), "findings") if findings is None else findings)
    rows = with_features(candidates(docs, id_col, text_col, path_col, near))
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
    rows = model.transform(rows.select("doc_id", "ordinal", "candidate", "features"))
    return rows.select(
        "doc_id",
        "ordinal",
        "candidate",
        F.length("candidate").cast("long").alias("n_chars"),
        F.round(vector_to_array("probability")[1], 6).alias("probability"),
        (vector_to_array("probability")[1] >= least).alias("kept"),
    )


def redact(docs: DataFrame, secrets: DataFrame, mask: str = "[secret]", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with the kept candidates of ``secrets`` (scan_secrets' rows) masked in the text.

    A candidate is masked wherever it is one in the rows of its identifier; rows that repeat an identifier,
    a null one too, share their secrets. Null texts stay null, and rows without secrets as they are.
    """
    kept = secrets.where("kept").groupBy(F.col("doc_id").alias("own_id")).agg(F.collect_set("candidate").alias("gone"))
    rows = one_column(docs)  # no column of the caller's can clash with one of ours
    text = F.col("row")[text_col]
    found = F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))
    parts = F.zip_with(
        F.split(text, CANDIDATE, -1),
        F.transform(found, lambda x: F.when(F.array_contains("gone", x), F.lit(mask)).otherwise(x)),
        lambda gap, x: F.concat(gap, F.coalesce(x, F.lit(""))),
    )
    masked = F.when(F.col("gone").isNull(), text).otherwise(F.array_join(parts, ""))
    rows = rows.join(kept, F.col("row")[id_col].eqNullSafe(F.col("own_id")), "left")
    return own_columns(rows.withColumn("row", F.col("row").withField(f"`{text_col}`", masked)), docs)

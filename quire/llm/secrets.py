"""Secret scans: candidates by shape, and a random forest that tells secrets from what only looks like one."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from functools import lru_cache, reduce
from itertools import islice
from pathlib import Path

import public_tokenizers
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import cut, let, shared_dir

#: The characters of candidates, and what lies between two of them: all else, escapes as in JSON included, save the \/ that
#: stands for a slash. No group is repeated here, so that a run of any length needs no stack.
SHAPE = r"[A-Za-z0-9+/_.~%@-]"
ENDS = r"[^A-Za-z0-9+/_.~%@\\-]+|\\u[0-9a-fA-F]{4}|\\[nrtbf]|\\(?!/)"

#: From which length on a run is a candidate wherever it stands, and from which beside a secret word, also of letters only. Beside a
#: secret word and a sign there is no least length, see TOLD.
LEAST, LEAST_BESIDE = 16, 6

#: Where a short secret starts and ends in a text: after and before what is no part of its run, or is trimmed off it.
RUN_STARTS, RUN_ENDS = r"(?:(?<![A-Za-z0-9+_@])|(?<=\\[nrtbf])|(?<=\\u[0-9a-fA-F]{4}))", r"(?![A-Za-z0-9+_@])"

#: Words that stand beside secrets, beside harmless digests and names, and in the paths of harmless files.
SECRET_WORDS = "token secret password passwd pwd pw passcode passphrase key apikey api_key access_key secret_key auth bearer credential credentials private authorization".split()
HARMLESS_WORDS = "commit sha sha1 sha256 sha512 md5 checksum hash digest uuid guid id version rev revision build isbn integrity etag ref blob tree file url order invoice tracking image see at page serial".split()
PASSWORD_WORDS = "password passwd pwd pw passcode passphrase secret".split()
SAMPLE_WORDS = "example sample test tests dummy fake placeholder your here changeme mock fixture fixtures docs demo redacted lock".split()

#: What is said to be a secret: a secret word, a sign or "is", and then anything up to white space or a quote. And what stands for a password in an address.
TOLD = rf"(?i)(?<![a-z0-9])({'|'.join(SECRET_WORDS)})[\"'`]?\s*(?:=>|:=|[:=]|\b(?:is|was)\b)\s*[\"'`]?([^\s\"'`]+)"
ADDRESS = r"(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]*+://[^\s/:@\"'`]*+:([^\s/@\"'`]++)@"
IN_ADDRESS = "credential://"

#: Words that the labelled lookalikes are made of. The dictionary that candidates are held against is another, see below.
NAME_WORDS = (
    "password secret token example sample config default value string number index table column handler manager service "
    "controller request response session account customer product message version update create delete select insert user "
    "name file path data image static assets module component test public private server client local host main page home "
    "key api your here read write load save get set list item node type class error event time date info with from and the "
    "tion ing ment able ness ough ight ance ence ther ious"
).split()

#: The dictionary for coverage: the most frequent words of at least so many letters in a public tokenizer's vocabulary, and how many.
VOCABULARY, WORD_LETTERS, DICTIONARY_WORDS = "byte_bpe_50k.json", 4, 600

#: Letter groups that prose is made of, for the labelled findings' common words.
GROUPS = "the re in on er an st nd wh ea ou tion ly ing ed en al or ti es is ar le la ci ent de que com pro con der sch ung eur ver ma li".split()

#: Labelled findings that the forest is fitted to: all that labelled_findings() makes by default. Trees and their depth.
LABELLED = 8000
TREES, DEPTH, SEED = 24, 9, 5
FIT_TASKS = 32

THRESHOLD = 0.5

#: Forests that this driver has read, by folder and session.
_FITTED: dict[tuple[str, int], PipelineModel] = {}

SECRET = "[SECRET]"

FEATURES = [
    "length", "digits", "uppers", "lowers", "symbols", "turns", "case_turns", "variety", "vowel_turns", "longest_letters", "hex", "dictionary",
    "path_like", "slashes", "sample", "near_secret", "near_harmless", "near_sample", "path_harmless", "odd", "marks", "near_password", "blank",
]


def _any_of(c: Column, words: list[str]) -> Column:
    """Whether any part of a name, split at its joints, is one of the words, or the whole is."""
    parts = F.split(F.lower(c), r"[^a-z0-9]+")
    return F.coalesce(F.arrays_overlap(F.concat(parts, F.array(F.lower(c))), F.array(*[F.lit(w) for w in words])), F.lit(False))


@lru_cache(maxsize=4)
def dictionary(path: str | None = None, most: int = DICTIONARY_WORDS) -> tuple[str, ...]:
    """The first `most` lower-case words of a vocabulary file by id, the most frequent first."""
    vocabulary = json.loads(Path(path or public_tokenizers.path(VOCABULARY)).read_text(encoding="utf-8"))["model"]["vocab"]
    words = (re.fullmatch(rf"\u0120?([a-z]{{{WORD_LETTERS},}})", x) for x in sorted(vocabulary, key=vocabulary.get))
    return tuple(islice(dict.fromkeys(m[1] for m in words if m), most))


def longest_of(words: tuple[str, ...]) -> str:
    """A pattern for the longest of the words at a place, their common beginnings read once."""
    heads: dict[str, list[str]] = {}
    for w in words:
        if w:
            heads.setdefault(w[0], []).append(w[1:])
    branches = "|".join(re.escape(head) + longest_of(tuple(tails)) for head, tails in sorted(heads.items()))
    return f"(?:{branches})" + "?" * ("" in words) if branches else ""


def _is_odd(candidate: Column, near: Column) -> Column:
    """Whether only a secret word and a sign, or a place in an address, made this a candidate: it has other signs than runs have, is short, or has no letter."""
    return candidate.rlike(f"[^{SHAPE[1:]}") | (F.length(candidate) < LEAST_BESIDE) | ~candidate.rlike("[A-Za-z]") | (near == IN_ADDRESS)


def with_features(findings: DataFrame) -> DataFrame:
    """findings (candidate, before, near, after, path) with a double column per feature, all by built-in functions."""
    c = F.replace(F.col("candidate"), F.lit("\\/"), F.lit("/"))
    n = F.length(c)
    low = F.lower(c)
    share = lambda pattern: F.regexp_count(c, F.lit(pattern)) / n
    known = F.length(F.regexp_replace(low, longest_of(dictionary()), ""))
    near = lambda words: reduce(lambda a, b: a | b, [_any_of(F.col(x), words) for x in ("before", "near", "after")])
    letters = F.transform(F.regexp_extract_all(c, F.lit("[A-Za-z]+"), 0), lambda x: F.length(x))
    values = {
        "length": F.length("candidate"),
        "digits": share("[0-9]"),
        "uppers": share("[A-Z]"),
        "lowers": share("[a-z]"),
        "symbols": share("[^A-Za-z0-9]"),
        # transitions between letters and digits, between cases, and between vowels and consonants
        "turns": share("(?<=[A-Za-z])[0-9]|(?<=[0-9])[A-Za-z]"),
        "case_turns": share("(?<=[a-z])[A-Z]|(?<=[A-Z])[a-z]"),
        "variety": F.size(F.array_distinct(F.split(c, ""))) / n,
        "vowel_turns": F.regexp_count(low, F.lit("(?<=[aeiou])[b-df-hj-np-tv-z]|(?<=[b-df-hj-np-tv-z])[aeiou]")) / n,
        "longest_letters": F.coalesce(F.array_max(letters), F.lit(0)) / n,
        "hex": c.rlike("^([0-9a-f]+|[0-9A-F]+)$"),
        "dictionary": 1 - known / n,
        "path_like": c.rlike(r"^[./~]|//|\.[a-z]{2,4}$|@|^www\."),
        "slashes": share("[/.]"),
        "sample": _any_of(c, SAMPLE_WORDS) | c.rlike(r"(?i)x{6,}|0{8,}|1234567"),
        "near_secret": near(SECRET_WORDS),
        "near_harmless": near(HARMLESS_WORDS),
        "near_sample": near(SAMPLE_WORDS),
        "path_harmless": _any_of(F.col("path"), SAMPLE_WORDS),
        "odd": _is_odd(F.col("candidate"), F.col("near")),
        "marks": share(r"[^\p{L}\p{N}]"),
        "near_password": _any_of(F.col("near"), PASSWORD_WORDS),
        # what stands for a secret that isn't there: a variable, a call, stars
        "blank": c.rlike(r"^[$%]?[({\[<].*[)}\]>]$|^[$%][A-Za-z_{(]|\(\)?$|^[^\p{L}\p{N}]*$") | (F.replace(c, F.left(c, F.lit(1)), F.lit("")) == ""),
    }
    return findings.withColumns({k: values[k].cast("double") for k in FEATURES})


def labelled_findings(spark: SparkSession, n: int = LABELLED, first: int = 0) -> DataFrame:
    """n findings made by rule from their numbers, with a label: 1 for secrets of common forms in telling places.

    Half are secrets: digests, random letters and digits, short ones, letters only, signed tokens and long keys of up
    to 1500 characters, and keys with a maker's prefix beside a secret's words. The others look like them: digests
    beside words for revisions and checksums, UUIDs, names, paths, numbers, samples, encoded files, and common words
    beside a secret's words. A quarter are what only a secret word and a sign, or an address, make candidates: passwords
    with all kinds of signs, short ones and numbers, and on the other side words, variables, stars and calls.
    """
    i = F.col("id")
    h = lambda salt: F.sha2(F.concat_ws(":", F.lit(salt), i.cast("string")), 256)
    pick = lambda words, salt: F.element_at(F.split(F.lit("|".join(words)), "[|]"), (F.pmod(F.xxhash64(F.lit(salt), i), F.lit(len(words))) + 1).cast("int"))
    length = lambda a, b: (F.pmod(F.xxhash64(F.lit("length"), i), F.lit(b - a + 1)) + a).cast("int")
    word = lambda salt: pick(NAME_WORDS, salt)
    title = lambda salt: F.initcap(word(salt))
    # digits, long keys, letters at random, and words of letter groups common in prose; cut, or the plan would repeat each of them in all forms
    many = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(36)), lambda k: F.base64(F.unhex(F.sha2(F.concat_ws(":", F.lit("many"), i, k), 256)))), "")
    prose = F.concat(*[pick(GROUPS, f"g{k}") for k in range(3)], F.when(F.pmod(i, F.lit(3)) == 0, F.concat(*[pick(GROUPS, f"g{k}") for k in (3, 4)])).otherwise(""))
    made = {
        "many": F.regexp_replace(many, "=", ""), "mixed": F.regexp_replace(F.base64(F.unhex(h("mixed"))), "[+/=]", ""), "digits": F.translate(h("digits"), "abcdef", ""),
        "lettered": F.regexp_replace(F.lower(F.base64(F.unhex(h("letters")))), "[^a-z]", ""), "prose": prose, "hexed": h("hex"), "a": word("a"), "b": word("b"), "c": word("c"), "d": word("d"),
    }
    numbers = cut(spark.range(first, first + n).withColumns(made))
    many, mixed, digits, lettered, prose, hexed = (F.col(x) for x in ("many", "mixed", "digits", "lettered", "prose", "hexed"))
    word = F.col
    safe = F.translate(many, "+/", "-_")
    uuid = F.concat_ws("-", *[F.substring(h("uuid"), a, b) for a, b in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    secrets = [
        F.substring(hexed, 1, 40), F.substring(hexed, 1, 32), hexed, F.substring(mixed, 1, 40), mixed,
        F.concat(pick(["ghp_", "glpat-", "xoxb-", "sk_live_", "pk-", "AIza"], "maker"), F.substring(mixed, 1, 32)),
        F.concat(F.lit("AKIA"), F.substring(F.upper(mixed), 1, 16)), F.concat_ws("-", F.substring(mixed, 1, 12), F.substring(mixed, 13, 14)),
        F.substring(mixed, F.lit(1), length(8, 15)), F.substring(hexed, F.lit(1), length(10, 15)), F.concat(prose, F.substring(digits, F.lit(1), length(1, 4))),
        F.substring(lettered, F.lit(1), length(16, 28)), F.upper(F.substring(lettered, F.lit(1), length(16, 28))),
        F.concat(F.lit("eyJ"), F.substring(safe, 1, 17), F.lit(".eyJ"), F.substring(safe, F.lit(18), length(60, 1400)), F.lit("."), F.substring(mixed, 1, 43)),
        F.substring(many, F.lit(1), length(60, 1500)),
    ]
    lookalikes = [
        F.substring(hexed, 1, 40), hexed, F.substring(hexed, 1, 32), uuid,
        F.concat(word("a"), title("b"), title("c"), title("d"), F.substring(digits, 1, 2)),
        F.concat_ws("_", word("a"), word("b"), word("c"), F.substring(digits, 1, 2)),
        F.concat(F.lit("/"), F.concat_ws("/", word("a"), word("b"), word("c")), F.lit("-"), F.substring(hexed, 1, 8), pick([".js", ".png", ".css", ".html"], "end")),
        F.concat(F.substring(digits, 1, 16), F.lit("a")), F.concat(F.lit("v"), F.concat_ws(".", F.substring(digits, 1, 2), F.substring(digits, 3, 3), F.substring(digits, 6, 12))),
        F.concat(pick(["your_", "example-", "test_", "EXAMPLE"], "s"), word("a"), F.lit("_key_"), F.substring(digits, 1, 4), F.lit("_here")),
        F.concat(F.repeat(F.lit("x"), 12), F.substring(digits, 1, 12)), F.concat(word("a"), F.lit("."), word("b"), F.substring(digits, 1, 3), F.lit("@"), word("c"), F.lit(".com")),
        F.substring(many, F.lit(1), length(60, 1500)), F.substring(many, F.lit(1), length(60, 1500)), F.substring(mixed, F.lit(1), length(6, 15)), F.substring(hexed, F.lit(1), length(7, 15)),
    ]
    common = [
        prose, F.initcap(prose), F.upper(prose), F.concat(prose, F.lit(".")), F.concat(word("a"), word("b")), F.concat(word("a"), title("b"), title("c")),
        F.concat_ws("_", word("a"), word("b"), word("c")), F.concat_ws("-", prose, word("b")), F.concat_ws("/", word("a"), word("b"), word("c")), F.concat(word("a"), F.lit("."), word("b"), F.substring(digits, 1, 2)),
        F.concat(word("a"), F.lit("."), F.substring(digits, 1, 2), F.lit("@"), word("b"), F.lit(".example.com")), F.concat(prose, prose),
    ]
    sign = lambda salt: pick(list("&!#$*^?;,()=+:"), salt)
    few = lambda a, b: F.substring(mixed, F.lit(1), length(a, b))
    spelt = F.translate(word("a"), "aeiost", "@31057")
    odd_secrets = [
        F.concat(few(3, 9), sign("s"), F.substring(mixed, 10, 6), sign("t")), F.concat(sign("s"), few(4, 16)), F.concat(title("a"), sign("s"), F.substring(digits, F.lit(1), length(1, 6)), sign("t")),
        F.substring(digits, F.lit(1), length(6, 24)), F.concat(F.substring(spelt, 1, 5), sign("s")), F.concat(F.lit("p@"), F.substring(lettered, F.lit(1), length(1, 3))), F.substring(spelt, F.lit(1), length(3, 5)),
        F.concat(F.substring(digits, F.lit(1), length(1, 3)), F.substring(lettered, F.lit(1), F.lit(1))), F.substring(hexed, F.lit(1), length(4, 5)), few(8, 24), F.concat(word("a"), F.substring(digits, F.lit(1), length(1, 4))),
        F.concat(F.lit("#"), F.substring(hexed, F.lit(1), length(6, 12))), F.concat(few(4, 8), F.lit("é"), sign("s"), F.substring(digits, 1, 2)),
    ]
    little = F.substring(prose, F.lit(1), length(1, 5))
    odd_common = [
        little, F.initcap(little), F.upper(little), F.concat(little, pick(list("!?;,)"), "s")), F.concat(word("a"), pick(list("!?;,)"), "s")), F.concat(word("a"), pick(["(", "=", ",", ";", "&"], "s"), word("b")),
        pick("true false none null yes no on off empty unset hidden required missing wrong set lost safe public ok".split(), "w"), F.translate(prose, "eaou", "éàöü"), F.concat(F.lit("l’"), prose), F.substring(digits, F.lit(1), length(1, 3)),
        F.concat(F.lit("${"), F.upper(word("a")), F.lit("}")), F.concat(F.lit("{{"), word("a"), F.lit("}}")), F.concat(F.lit("<"), word("a"), F.lit(">")), F.concat(word("a"), F.lit("()")), F.concat(F.lit("$"), F.upper(word("a"))),
        F.repeat(pick(list("*.-x#"), "s"), length(1, 12)), F.concat(F.lit("("), word("a"), F.lit(")")), F.concat(F.lit("["), word("a"), F.lit("]")), F.concat(word("a"), F.lit("(")), F.concat(F.lit("%"), word("a")),
    ]
    form = lambda columns: F.pmod(F.xxhash64(F.lit("form"), i), F.lit(len(columns)))
    chosen = lambda columns: F.coalesce(*[F.when(form(columns) == k, x) for k, x in enumerate(columns)])
    positive = F.pmod(i, F.lit(2)) == 1
    plain = lambda salt: pick([*NAME_WORDS, "", "="], salt)
    # one in eight secrets, those with a maker's prefix or mixed case apart, has no telling word: it is a lookalike then
    told = F.pmod(F.xxhash64(F.lit("told"), i), F.lit(8)) > 0
    sample = F.pmod(F.xxhash64(F.lit("sample"), i), F.lit(10)) == 0
    # so are short ones, those of letters only, and long ones without a signed token's dots
    unclear = F.col("secret").rlike("^[0-9a-f]+$|^.{0,15}$|^[a-z]+$|^[A-Z]+$|^[^.]{60,}$")
    label = positive & (told | ~unclear) & ~sample
    beside = ~positive & (F.pmod(F.xxhash64(F.lit("beside"), i), F.lit(3)) == 0)
    near = F.when(sample, pick(SAMPLE_WORDS, "n")).when((positive & told) | beside, pick(SECRET_WORDS, "n")).when(positive, plain("n")).otherwise(
        F.when(F.pmod(F.xxhash64(F.lit("said"), i), F.lit(3)) > 0, pick(HARMLESS_WORDS, "n")).otherwise(plain("n"))
    )
    path = F.concat_ws("/", plain("p"), F.when(~label & (F.pmod(i, F.lit(7)) == 0), pick(SAMPLE_WORDS, "path")).otherwise(plain("q")))
    usual = F.pmod(F.xxhash64(F.lit("odd"), i), F.lit(4)) > 0
    # a number is a secret where a password is spoken of, and not where a key or token is
    odd_near = F.when(F.pmod(F.xxhash64(F.lit("address"), i), F.lit(6)) == 0, IN_ADDRESS).otherwise(pick(SECRET_WORDS, "n"))
    odd_near = F.when(positive & F.col("odd").rlike("^[0-9]+$"), pick(PASSWORD_WORDS, "n")).otherwise(odd_near)
    forms = numbers.select("id", F.when(positive, chosen(secrets)).otherwise("").alias("secret"), F.when(positive, chosen(odd_secrets)).otherwise(chosen(odd_common)).alias("odd"), F.when(beside, chosen(common)).otherwise(chosen(lookalikes)).alias("other"))
    rows = cut(forms).select(
        F.when(~usual, F.col("odd")).when(positive, F.col("secret")).otherwise(F.col("other")).alias("candidate"),
        F.when(usual, plain("b")).otherwise("").alias("before"), F.when(usual, near).otherwise(odd_near).alias("near"), F.when(usual, plain("a")).otherwise("").alias("after"),
        F.when(usual, path).otherwise(plain("p")).alias("path"), F.when(usual, label).otherwise(positive).cast("double").alias("label"), usual.alias("usual"),
    )
    return cut(rows).where(F.col("usual") | _is_odd(F.col("candidate"), F.col("near"))).drop("usual")


def fit_forest(findings: DataFrame, most: int = LABELLED) -> PipelineModel:
    """A forest fitted to labelled findings: candidate, before, near, after, path, and label 0.0 or 1.0.

    At most `most` of them, those of least hash, are taken, their features found by FIT_TASKS tasks, and then in one
    order in one partition: the same findings give the same forest, and any number of them a bounded task.
    """
    own = findings.select("candidate", "before", "near", "after", "path", "label")
    rows = own.orderBy(F.xxhash64(*own.columns), *own.columns).limit(most)
    rows = with_features(rows.repartition(FIT_TASKS)).repartition(1).sortWithinPartitions("candidate", "before", "near", "after", "path", "label").select(*FEATURES, "label")
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED)
    return Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"), forest]).fit(rows)


def fitted(findings: DataFrame) -> PipelineModel:
    """fit_forest(findings), kept in the shared folder under a digest of the findings and of how they are fitted, so it is fitted once."""
    spark = findings.sparkSession
    own = findings.select("candidate", "before", "near", "after", "path", "label")
    rows = own.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*own.columns).cast("decimal(38,0)"))).first()
    key = hashlib.sha256(repr((tuple(rows), FEATURES, SECRET_WORDS, PASSWORD_WORDS, HARMLESS_WORDS, SAMPLE_WORDS, dictionary(), LABELLED, TREES, DEPTH, SEED)).encode()).hexdigest()[:32]
    folder = f"{shared_dir(spark)}/forest-{key}"
    if (folder, id(spark)) not in _FITTED:
        path = spark._jvm.org.apache.hadoop.fs.Path
        files = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
        if not files.exists(path(folder)):
            draft = f"{folder}-{uuid.uuid4().hex}"
            fit_forest(findings).write().save(draft)
            if not files.rename(path(draft), path(folder)) or files.exists(path(f"{folder}/{path(draft).getName()}")):
                files.delete(path(draft), True)  # another driver was first
        _FITTED[folder, id(spark)] = PipelineModel.load(folder)
    return _FITTED[folder, id(spark)]


def candidates(docs: DataFrame, id: str, text: str, path: str | None) -> DataFrame:
    """doc_id, row (hash of the text), candidate, before, near (the word right before it), after and path, per distinct finding.

    A candidate is a whole run of SHAPE, without stops and slashes at its ends, of LEAST characters or more with a digit
    and a letter, or with a lower-case letter before two capitals; there is no greatest length. Beside a secret word
    (one of the two runs before, or the run after) it is any run of LEAST_BESIDE characters or more with a letter. Runs
    are told apart within their text, without a shuffle; slashes escaped as in JSON are part of a run. Behind a secret
    word and a sign, or "is", a candidate is all up to white space or a quote, without stops and brackets at its end,
    whatever its length and letters; in an address it is what stands for the password.
    """
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    run = r"[A-Za-z0-9+/_.~%@\\-]+"
    shape = rf"^(?=[^0-9]*[0-9])(?=[^A-Za-z]*[A-Za-z]){run}$|^(?=[^a-z]*[a-z].*[A-Z].*[A-Z]){run}$"
    told = rf"(?i)(?<![a-z0-9])(?:{'|'.join(SECRET_WORDS)})(?![a-z0-9])"

    def inside(words: Column, telling: Column) -> Column:
        def found(w: Column, i: Column) -> Column:
            bare = F.btrim(w, F.lit(".-/%~\\"))
            context = [F.coalesce(F.get(words, i + k), F.lit("")).alias(name) for k, name in ((-2, "before"), (-1, "near"), (1, "after"))]
            beside = telling & bare.rlike("[A-Za-z]") & F.concat_ws(" ", *context).rlike(told)
            is_one = (F.length(w) >= LEAST_BESIDE) & (F.length(bare) >= LEAST_BESIDE) & (((F.length(bare) >= LEAST) & bare.rlike(shape)) | beside)
            return F.when(is_one, F.struct(bare.alias("candidate"), *context))

        return F.array_compact(F.transform(words, found))

    def said(candidate: Column, near: Column) -> Column:
        nothing = F.lit("")
        return F.when((candidate != "") & _is_odd(candidate, near), F.struct(candidate.alias("candidate"), nothing.alias("before"), near.alias("near"), nothing.alias("after")))

    def told_of(t: Column) -> Column:
        said_at = lambda m: F.regexp_replace(F.regexp_extract(m, TOLD, 2), r"(?s)\\(?:[nrtbf]|u[0-9a-fA-F]{4}).*", "")  # noqa: E731  up to an escape
        value = lambda m: F.rtrim(said_at(m), F.lit(".,;:)]}>"))
        whole = lambda m: F.when(value(m).rlike(r"[({\[<]"), F.rtrim(said_at(m), F.lit(".,;:"))).otherwise(value(m))  # noqa: E731  a bracket that was opened is shut
        by_word = F.transform(F.regexp_extract_all(t, F.lit(TOLD), F.lit(0)), lambda m: said(whole(m), F.lower(F.regexp_extract(m, TOLD, 1))))
        by_place = F.transform(F.regexp_extract_all(t, F.lit(ADDRESS), F.lit(1)), lambda x: said(x, F.lit(IN_ADDRESS)))
        return F.array_compact(F.concat(by_word, by_place))

    own = docs.select(
        F.col(f"`{id}`").alias("doc_id"), t.alias("t"), F.coalesce(F.col(f"`{path}`").cast("string"), F.lit("")).alias("path") if path else F.lit("").alias("path")
    ).withColumn("telling", F.col("t").rlike(told))
    some = own.where(F.col("telling") | F.col("t").rlike(rf"[A-Za-z0-9+/_.~%@\\-]{{{LEAST}}}") | F.contains("t", F.lit("://")))
    runs = F.filter(F.split("t", ENDS), lambda w: w != "")
    by_run = let(runs, lambda words: inside(words, F.col("telling")))
    odd = F.when(F.col("telling") | F.contains("t", F.lit("://")), told_of(F.col("t")))
    both = F.array_distinct(F.when(odd.isNull(), by_run).otherwise(F.concat(by_run, odd)))
    rows = some.select("doc_id", F.xxhash64("t").alias("row"), "path", F.explode(both).alias("f"))
    return rows.select("doc_id", "row", "path", "f.*")


def scan_secrets(docs: DataFrame, id: str = "doc_id", text: str = "text", path: str | None = "source", findings: DataFrame | None = None) -> DataFrame:
    """One row per document and distinct finding: doc_id, row, candidate, before, near, after, path, probability, is_secret.

    Findings are runs that could be secrets; the forest, fitted to `findings` or by default to labelled_findings(),
    removes false positives: is_secret is false for those. A candidate found in a text in several contexts has a row
    each. Null and empty texts have no findings; rows with equal ids are scanned one by one; an empty table gives an
    empty result. Only id, text and path are read; path may be None.
    """
    model = fitted(findings if findings is not None else labelled_findings(docs.sparkSession))
    judged = model.transform(with_features(candidates(docs, id, text, path)))
    p = vector_to_array("probability")[1]
    return judged.select("doc_id", "row", "candidate", "before", "near", "after", "path", F.round(p, 6).alias("probability"), (p >= THRESHOLD).alias("is_secret"))


def redact_secrets(docs: DataFrame, id: str = "doc_id", text: str = "text", chars: str = "n_chars", path: str | None = "source") -> DataFrame:
    """docs with each secret in the text replaced by SECRET, and the length column brought up to date if there is one.

    Every row stays, null and empty texts as they are; rows with equal ids are looked at one by one; of secrets that
    lie in one another the longer goes. An empty table stays empty. Columns of any other name stay as they are.
    """
    found = scan_secrets(docs, id, text, path if path in docs.columns else None).where("is_secret")
    # longer ones first: one secret may hold another
    listed = found.groupBy("doc_id", "row").agg(F.collect_set("candidate").alias("c"))
    listed = listed.select(F.col("doc_id").alias("__id"), F.col("row").alias("__row"), F.expr("transform(sort_array(transform(c, x -> struct(length(x) as n, x as x)), false), y -> y.x)").alias("__secrets"))
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    joined = docs.join(listed.hint("merge"), F.col(f"`{id}`").eqNullSafe(F.col("__id")) & (F.xxhash64(t) == F.col("__row")), "left")
    # all in one pass, so that none is looked for in SECRET itself; short ones only where they are a run, not within a longer one, or stand in an address
    whole = lambda x: F.concat(F.lit(r"\Q"), F.replace(x, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    as_run = lambda x: F.concat(F.lit(RUN_STARTS), whole(x), F.lit(RUN_ENDS + "|(?<=:)"), whole(x), F.lit("(?=@)"))
    quoted = F.transform("__secrets", lambda x: F.when(F.length(x) >= LEAST, whole(x)).otherwise(as_run(x)))
    clean = F.regexp_replace(t, F.array_join(quoted, "|"), F.lit(SECRET))
    joined = joined.withColumn("__clean", F.when(F.col("__secrets").isNotNull(), clean))
    out = {text: F.coalesce("__clean", F.col(f"`{text}`"))}
    if chars in docs.columns:
        out[chars] = F.coalesce(F.length("__clean").cast(docs.schema[chars].dataType), F.col(f"`{chars}`"))
    return joined.select(*[out[c].alias(c) if c in out else F.col(f"`{c}`") for c in docs.columns])

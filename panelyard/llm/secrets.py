"""Secret scans: fixed patterns, and strings that a character Markov model of random strings explains better.

Two first-order character models, one of random strings and one of ordinary identifiers, are trained from labelled
samples by counting bigrams. A candidate is a long run of key characters outside the fixed patterns' matches. In it,
the stretches of words (between separators) with the highest log-likelihood ratio of the models are looked for, so that
the text around a secret doesn't hide it; where the ratio per character passes a threshold, a stretch is reported. All
of it is column expressions: matches and the text between them give the places, and scores are summed over an array
that holds the log ratio of every pair of characters.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The base patterns in the order in which kinds are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")

#: Characters of candidates, in the order of their codes in the models.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-="
LEAST = 20
CANDIDATE = f"[A-Za-z0-9+/_=-]{{{LEAST},}}"
#: Words of a candidate, with the signs that pad base64 or set a value apart.
WORD = "[A-Za-z0-9]+=*"
#: Words after its first that a stretch is looked for in; LEAST characters have at most half as many words.
REACH = 24

#: Labelled sample of ordinary identifiers, paths and words.
IDENTIFIERS = """
get_user_by_id set_default_timeout parse_request_headers is_valid_email_address load_configuration_from_file
connection_pool_size max_retry_attempts write_output_directory compute_checksum_for_block handle_unexpected_error
create_database_session remove_trailing_whitespace convert_to_absolute_path read_next_available_record
update_last_modified_time number_of_active_workers find_common_ancestor initialize_random_generator
getElementById addEventListener removeAttribute createDocumentFragment requestAnimationFrame parseInteger
setConnectionTimeout isAuthenticatedUser hasOwnProperty toLocaleDateString getBoundingClientRect stringifyResponse
HttpServletRequest AbstractFactoryBean ConcurrentHashMap IllegalArgumentException BufferedInputStream
SimpleDateFormat NullPointerException AuthenticationManager ConfigurationProperties DocumentBuilderFactory
MAX_BUFFER_SIZE DEFAULT_TIMEOUT_SECONDS ENABLE_EXPERIMENTAL_FEATURES DATABASE_CONNECTION_STRING LOG_LEVEL_WARNING
src/main/java/org/example/service/UserService usr/local/share/applications include/linux/kernel/module
docs/getting-started/installation-guide assets/images/background-large static/css/bootstrap-responsive
background-color border-bottom-width text-decoration-line align-self-flex-start user-interface-guidelines
internationalization misunderstanding responsibilities characteristically incomprehensible environmentally
straightforwardness counterproductive telecommunications electroencephalogram interdisciplinary extraordinarily
unglücklicherweise Geschwindigkeitsbegrenzung Krankenversicherung Verantwortung Zusammenarbeit Wissenschaft
anticonstitutionnellement gouvernement developpement malheureusement administration renseignements
desafortunadamente responsabilidades electrodomesticos independientemente caracteristicas universidades
the_quick_brown_fox_jumps_over_the_lazy_dog once-upon-a-time-in-a-land-far-away chapter-twenty-three-section-four
version_1_2_3 release-2023-10-05 build_number_1042 page=2 item_id=17 index.html year2024 test_case_12 utf-8 base64
========================= ------------------------- _________________________ aaaaaaaaaaaaaaaaaaaaaaaaaa
"""


def random_samples(spark: SparkSession, n: int) -> DataFrame:
    """Labelled random strings, from digests of counters: base64, letters and digits, and lower-case base 36."""
    raw = F.unhex(F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")), 256))
    text = F.base64(raw)
    kinds = F.array(text, F.regexp_replace(text, "[^A-Za-z0-9]", ""), F.regexp_replace(text, "[^a-z0-9]", ""), F.translate(text, "+/", "-_"))
    return spark.range(n).select(F.explode(kinds).alias("text"), F.lit(True).alias("random"))


def samples(spark: SparkSession, n: int = 400) -> DataFrame:
    """The labelled table: text, random."""
    words = spark.range(1).select(F.explode(F.split(F.lit(IDENTIFIERS.strip()), r"\s+")).alias("text"), F.lit(False).alias("random"))
    return random_samples(spark, n).unionByName(words)


def bigram_ratios(labelled: DataFrame, weights: tuple[float, float] = (0.5, 0.05)) -> list[float]:
    """log P(next | char) under the random model less that under the identifier model, for every pair of ALPHABET.

    labelled: text, random. Bigrams are counted by Spark; what comes to the driver has a row per pair and label, at
    most twice the alphabet squared. weights are added to the counts of the random and of the identifier model; the
    second is small, so that pairs which identifiers don't have speak for a random string.
    """
    k = len(ALPHABET)
    pairs = labelled.where(F.length("text") > 1).select("random", F.explode(F.transform(F.sequence(F.lit(1), F.length("text") - 1), lambda i: F.substring("text", i, F.lit(2)))).alias("g"))
    counts = {(r.random, r.g): r["count"] for r in pairs.groupBy("random", "g").count().collect()}
    out = []
    for a in ALPHABET:
        row = [[counts.get((kind, a + b), 0) + w for b in ALPHABET] for kind, w in zip((True, False), weights, strict=True)]
        total = [sum(r) for r in row]
        out += [math.log(row[0][j] / total[0]) - math.log(row[1][j] / total[1]) for j in range(k)]
    return out


SPAN = "array<struct<start: int, kind: int, end: int, value: string>>"
STEP = 256


def places(text: Column, pattern: str, kind: str) -> Column:
    """The pattern's leftmost matches: array of start, kind (its number), end, value; code points, end exclusive.

    Matches and the text between them are summed in steps of STEP, so that a text with very many matches stays cheap.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(found.alias("m"), F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)).alias("g"))
    steps = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / STEP).cast("int")), lambda i: F.slice(pairs, i * STEP + 1, F.lit(STEP)))
    width = lambda x: F.length(x["g"]) + F.length(x["m"])
    widths = F.transform(steps, lambda s: F.aggregate(s, F.lit(0), lambda n, x: n + width(x)))
    none = F.array().cast(SPAN)

    def spans(step: Column, i: Column) -> Column:
        before = F.aggregate(F.slice(widths, F.lit(1), i), F.lit(0), lambda n, w: n + w)

        def add(acc: Column, x: Column) -> Column:
            start = F.coalesce(F.get(acc, F.size(acc) - 1)["end"], before) + F.length(x["g"])
            one = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (start + F.length(x["m"])).alias("end"), x["m"].alias("value"))
            return F.concat(acc, F.array(one))

        return F.aggregate(step, none, add)

    return F.when(F.regexp_like(text, F.lit(pattern)), F.flatten(F.transform(steps, spans))).otherwise(none)


def let(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def gains(value: Column, ratios: list[float], threshold: float) -> Column:
    """The log-likelihood ratio less threshold of every pair of neighbours in a run of ALPHABET's characters."""
    table = F.expr("cast(split('" + ",".join(f"{x:.4f}" for x in ratios) + "', ',') as array<double>)")
    codes = F.transform(F.split(value, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    return let(codes, lambda c: F.transform(F.sequence(F.lit(0), F.length(value) - 2), lambda i: F.get(table, F.get(c, i) * len(ALPHABET) + F.get(c, i + 1)) - threshold))


def gain(pairs: Column, start: Column, end: Column) -> Column:
    """The sum of gains inside the characters from start to end, exclusive."""
    return F.aggregate(F.slice(pairs, start + 1, end - start - 1), F.lit(0.0), lambda n, x: n + x)


STRETCHES = "array<struct<start: int, end: int>>"


def stretches(value: Column, ratios: list[float], threshold: float) -> Column:
    """Start and end of what in a run of ALPHABET's characters looks random: array, in order and apart.

    From every word on, the stretch of LEAST or more characters and whole words with the highest gain is taken, up to
    where its gain becomes negative. One that a later, better one overlaps began with ordinary words and is left out;
    the others are joined where they overlap. Where there is none, the run as a whole is judged.
    """
    none = F.lit(-1e9)

    def words(pairs: Column) -> Column:
        between = lambda p, x, i: F.when(i > 0, gain(pairs, F.get(p, i - 1)["end"] - 1, x["start"] + 1)).otherwise(0.0)
        one = lambda p, x, i: F.struct(x["start"], x["end"], gain(pairs, x["start"], x["end"]).alias("own"), between(p, x, i).alias("gap"))
        return let(places(value, WORD, "random"), lambda p: F.transform(p, lambda x, i: one(p, x, i)))

    def best_from(w: Column, x: Column, i: Column) -> Column:
        def add(acc: Column, y: Column) -> Column:
            def take(now: Column) -> Column:
                enough = y["end"] - acc["start"] >= LEAST
                done = acc["done"] | (enough & (now < 0))
                better = ~done & enough & (now > acc["best"])
                return F.struct(acc["start"], F.when(better, y["end"]).otherwise(acc["end"]).alias("end"), now.alias("now"), F.when(better, now).otherwise(acc["best"]).alias("best"), done.alias("done"))

            return let(acc["now"] + y["gap"] + y["own"], take)

        alone = F.when(x["end"] - x["start"] >= LEAST, x["own"]).otherwise(none)
        first = F.struct(x["start"], x["end"], x["own"].alias("now"), alone.alias("best"), F.lit(False).alias("done"))
        return F.aggregate(F.slice(w, i + 2, F.lit(REACH)), first, add)

    def join(acc: Column, x: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        return F.when(F.coalesce(last["end"] > x["start"], F.lit(False)), F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(acc, F.array(F.struct(x["start"], x["end"]))))

    def apart(hits: Column) -> Column:
        beaten = lambda x, i: F.exists(F.slice(hits, i + 2, F.lit(REACH)), lambda y: (y["start"] < x["end"]) & (y["best"] > x["best"]))
        return F.aggregate(F.filter(hits, lambda x, i: ~beaten(x, i)), F.array().cast(STRETCHES), join)

    def found(pairs: Column) -> Column:
        hits = let(words(pairs), lambda w: F.filter(F.transform(w, lambda x, i: best_from(w, x, i)), lambda x: x["best"] >= 0))
        whole = F.array(F.struct(F.lit(0).alias("start"), F.length(value).alias("end")))
        judged = F.when(gain(pairs, F.lit(0), F.length(value)) >= 0, whole).otherwise(F.array().cast(STRETCHES))
        return let(let(hits, apart), lambda out: F.when(F.size(out) > 0, out).otherwise(judged))

    return let(gains(value, ratios, threshold), found)


def outside(run: Column, base: Column) -> Column:
    """The parts of run, LEAST or more characters long, between the spans of base: array of start, end, value."""
    touching = F.filter(base, lambda b: (b["start"] < run["end"]) & (b["end"] > run["start"]))
    ends = F.array(F.struct(run["end"].alias("start"), run["end"].alias("end")))

    def cut(acc: Column, b: Column) -> Column:
        part = F.struct(acc["at"].alias("start"), b["start"].alias("end"))
        return F.struct(F.greatest(acc["at"], b["end"]).alias("at"), F.when(b["start"] - acc["at"] >= LEAST, F.concat(acc["parts"], F.array(part))).otherwise(acc["parts"]).alias("parts"))

    spans = F.transform(touching, lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end")))
    parts = F.aggregate(F.concat(spans, ends), F.struct(run["start"].alias("at"), F.array().cast(STRETCHES).alias("parts")), cut)["parts"]
    return F.transform(parts, lambda p: F.struct(p["start"], p["end"], F.substring(run["value"], p["start"] - run["start"] + 1, p["end"] - p["start"]).alias("value")))


def random_spans(runs: Column, base: Column, ratios: list[float], threshold: float) -> Column:
    """Spans of the stretches of runs that look random, outside base."""

    def span(part: Column, x: Column) -> Column:
        start, end = part["start"] + x["start"], part["start"] + x["end"]
        return F.struct(start.alias("start"), F.lit(KINDS.index("random")).alias("kind"), end.alias("end"), F.substring(part["value"], x["start"] + 1, x["end"] - x["start"]).alias("value"))

    parts = F.flatten(F.transform(runs, lambda run: outside(run, base)))
    return F.flatten(F.transform(parts, lambda part: F.transform(stretches(part["value"], ratios, threshold), lambda x: span(part, x))))


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def secret_spans(docs: DataFrame, text_col: str = "text", threshold: float = 0.1, labelled: DataFrame | None = None) -> DataFrame:
    """docs with base and spans: arrays of start, kind, end, value in the order of start, then kind.

    base holds the fixed patterns' matches; spans holds these and the random strings outside them, of LEAST or more
    characters, whose mean log-likelihood ratio per character is at least threshold (nats). kind counts in KINDS. Null and empty texts have
    none; repeated rows are scanned alike; columns of docs named base or spans are replaced. One pass over the texts
    without a shuffle; labelled (text, random) replaces the built-in training table.
    """
    ratios = bigram_ratios(samples(docs.sparkSession) if labelled is None else labelled)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    assign = F.filter(places(text, ASSIGN, "assign"), lambda x: F.length(F.regexp_extract(x["value"], ASSIGN, 2)) >= 8)
    base = F.array_sort(F.concat(assign, places(text, ACCESS, "access"), places(text, HEX, "hex")))
    out = docs.withColumns({"base": base, "_runs": places(text, CANDIDATE, "random")})
    return out.withColumn("spans", F.array_sort(F.concat("base", random_spans(F.col("_runs"), F.col("base"), ratios, threshold)))).drop("_runs")

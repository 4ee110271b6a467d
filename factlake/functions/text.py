"""Column functions over text: similarity, cues, sentences, slots, links, secrets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY = 86_400_000
BLANKS = r"^\s+|\s+$"


def let(value: Column, body) -> Column:
    """``body`` of ``value``, with ``value`` computed once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, BLANKS, "")


# ---- similarity -------------------------------------------------------------


def trigrams(text: Column) -> Column:
    """Distinct windows of three characters, two blanks on either side."""
    padded = F.concat(F.lit("  "), F.lower(text), F.lit("  "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))


def trigram_similarity(a: Column, b: Column) -> Column:
    x, y = trigrams(a), trigrams(b)
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def jaro_winkler(a: Column, b: Column) -> Column:
    """Similarity of short names, in column functions.

    Each character of ``a`` takes the first free equal character of ``b`` within
    the window; the fold carries the places of ``b`` that are taken.
    """
    la, lb = F.length(a), F.length(b)
    window = F.greatest(F.floor(F.greatest(la, lb) / 2).cast("int") - 1, F.lit(0))
    chars = lambda s: F.filter(F.split(s, ""), lambda c: c != "")

    def measure(x: Column, y: Column) -> Column:
        start = F.struct(F.array().cast("array<int>").alias("i"), F.array().cast("array<int>").alias("j"))

        def step(acc: Column, i: Column) -> Column:
            free = F.filter(
                F.sequence(F.greatest(i - window, F.lit(0)), F.least(i + window, lb - 1)),
                lambda j: (F.get(y, j) == F.get(x, i)) & ~F.array_contains(acc["j"], j),
            )
            hit = (i - window < lb) & (F.size(free) > 0)
            took = F.struct(F.concat(acc["i"], F.array(i)).alias("i"), F.concat(acc["j"], F.slice(free, 1, 1)).alias("j"))
            return F.when(hit, took).otherwise(acc)

        def score(m: Column) -> Column:
            n = F.size(m["i"]).cast("double")
            left, right = m["i"], F.sort_array(m["j"])
            swapped = F.size(F.filter(F.zip_with(left, right, lambda i, j: F.get(x, i) != F.get(y, j)), lambda d: d)) / 2
            jaro = F.when(n > 0, (n / la + n / lb + (n - F.floor(swapped)) / n) / 3).otherwise(0.0)
            same = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.coalesce(F.get(x, i) == F.get(y, i), F.lit(False)))
            lead = F.when(~F.get(same, 0), 0).when(~F.get(same, 1), 1).when(~F.get(same, 2), 2).when(~F.get(same, 3), 3).otherwise(4)
            return F.when(jaro > 0.7, jaro + lead * 0.1 * (1 - jaro)).otherwise(jaro)

        pairs = F.aggregate(F.sequence(F.lit(0), la - 1), start, step)
        return let(pairs, score)

    both = let(F.struct(chars(a).alias("x"), chars(b).alias("y")), lambda s: measure(s["x"], s["y"]))
    return F.when((la == 0) & (lb == 0), 1.0).when((la == 0) | (lb == 0), 0.0).otherwise(both)


# ---- fact types from cues -----------------------------------------------------

#: Cues of each fact type, tried in this order.
CUES = [
    ("question", [
        ("ends", "?"), ("starts", "question"), ("contains", " why "), ("starts", "why "),
    ]),
    ("decision", [
        ("contains", "decided"), ("starts", "decision"), ("contains", "we picked"), ("contains", "we chose"), ("contains", "i chose"),
        ("contains", "i picked"), ("contains", "let's go with"), ("contains", "going with"), ("contains", "rolled out"),
    ]),
    ("preference", [
        ("starts", "preference"), ("contains", "i prefer"), ("contains", "we prefer"), ("contains", "user prefers"), ("contains", "team prefers"),
        ("contains", "my favorite"), ("contains", "my favourite"), ("contains", "i like "), ("contains", "i dislike "),
    ]),
    ("lesson", [
        ("starts", "lesson"), ("contains", "we learned"), ("contains", "i learned"), ("contains", "learned that"), ("contains", "tried "),
        ("contains", "turns out"), ("contains", "wish i had"), ("contains", "root cause was"), ("contains", "caused by"),
    ]),
    ("error", [
        ("starts", "error"), ("starts", "mistake"), ("contains", "avoid "), ("contains", "do not "), ("contains", "don't "),
        ("contains", "never again"), ("contains", "was a mistake"), ("contains", "failure mode"),
    ]),
    ("convention", [
        ("contains", " always "), ("starts", "always "), ("contains", " never "), ("contains", "convention"), ("contains", "house rule"),
        ("contains", " rule:"),
    ]),
    ("pattern", [
        ("contains", "pattern"), ("contains", " is implemented with "), ("contains", " are implemented with "), ("contains all", [" uses ", " for "]),
    ]),
    ("claim", [
        ("contains", "we believe"), ("contains", "we think"), ("starts", "claim:"), ("contains", " claim "),
    ]),
]
#: Words in headings, English and Korean.
HEADINGS = [
    ("decision", ["decision", "결정", "전략", "strategy", "strategic"]), ("convention", ["convention", "규칙", "표준"]),
    ("pattern", ["pattern", "패턴", "방법"]), ("note", ["note", "메모", "참고"]), ("question", ["question", "질문", "?"]),
    ("claim", ["claim", "주장"]),
]


def infer_fact_type(text: Column) -> Column:
    """The first type one of whose cues occurs, else ``note``."""

    def pick(low: Column) -> Column:
        def holds(cue: tuple) -> Column:
            kind, needle = cue
            if kind == "contains all":
                return reduce(lambda a, b: a & b, [low.contains(n) for n in needle])
            return {"starts": low.startswith, "ends": low.endswith, "contains": low.contains}[kind](needle)

        out = F.when(F.lit(False), "")
        for name, cues in CUES:
            out = out.when(reduce(lambda a, b: a | b, [holds(c) for c in cues]), name)
        return out.otherwise("note")

    return let(stripped(F.lower(text)), pick)


def infer_fact_type_sql(text: str) -> str:
    """The same as a SQL expression."""
    low = f"regexp_replace(lower({text}), '^\\s+|\\s+$', '', 'g')"
    quote = lambda s: "'" + s.replace("'", "''") + "'"

    def holds(cue: tuple) -> str:
        kind, needle = cue
        if kind == "contains all":
            return " AND ".join(f"contains({low}, {quote(n)})" for n in needle)
        return f"{ {'starts': 'starts_with', 'ends': 'ends_with', 'contains': 'contains'}[kind]}({low}, {quote(needle)})"

    whens = " ".join(f"WHEN {' OR '.join(f'({holds(c)})' for c in cues)} THEN '{name}'" for name, cues in CUES)
    return f"CASE {whens} ELSE 'note' END"


def heading_fact_type(heading: Column) -> Column:
    low, out = F.lower(heading), F.when(F.lit(False), "")
    for name, words in HEADINGS:
        out = out.when(reduce(lambda a, b: a | b, [low.contains(w) for w in words]), name)
    return out.otherwise("unknown")


# ---- sentences and candidates -------------------------------------------------

SPEAKER = r"^\p{Lu}[\p{L}\p{N}_-]{0,31}:\s*"


def without_speaker(sentence: Column) -> Column:
    """Leading quote marks and a capitalised ``Name:`` go."""
    return F.regexp_replace(F.regexp_replace(sentence, r"^>+\s*", ""), SPEAKER, "")


def sentences(text: Column) -> Column:
    parts = F.transform(F.split(text, r"[.!?;\n\r]", -1), lambda s: without_speaker(stripped(s)))
    return F.filter(parts, lambda s: s != "")


def candidate_score(sentence: Column, has_entity: Column, fact_type: Column) -> Column:
    """Confidence of a sentence; lengths are in bytes."""
    n = F.octet_length(sentence)
    size = F.when((n >= 30) & (n <= 200), 0.15).when(n < 30, 0.05).otherwise(0.0)
    typed = F.when(~fact_type.isin("note", "unknown"), 0.20).otherwise(0.0)
    return F.least(F.lit(1.0), 0.40 + F.when(has_entity, 0.25).otherwise(0.0) + typed + size)


def candidates(texts: DataFrame, names: list[str], text: str = "content") -> DataFrame:
    """(id, pos, sentence, entities, fact_type, confidence) of sentences of 10 to
    600 bytes. ``names`` are the caller's entity names; those under three bytes do not count."""
    rows = texts.select("id", F.posexplode(sentences(F.col(text))).alias("pos", "sentence"))
    rows = rows.where(F.octet_length("sentence").between(10, 600))
    known = F.array(*[F.lit(n) for n in dict.fromkeys(names) if len(n.encode()) >= 3]).cast("array<string>")
    found = F.filter(known, lambda n: F.lower("sentence").contains(F.lower(n)))
    rows = rows.withColumn("entities", found).withColumn("fact_type", infer_fact_type(F.col("sentence")))
    return rows.withColumn("confidence", candidate_score(F.col("sentence"), F.size("entities") > 0, F.col("fact_type")))


# ---- slots --------------------------------------------------------------------

#: English number words.
NUMBERS = dict(
    zero="0", one="1", two="2", three="3", four="4", five="5", six="6", seven="7", eight="8", nine="9", ten="10",
    eleven="11", twelve="12", thirteen="13", fourteen="14", fifteen="15", sixteen="16", seventeen="17", eighteen="18",
    nineteen="19", twenty="20", thirty="30", forty="40", fifty="50", sixty="60", seventy="70", eighty="80", ninety="90",
    hundred="100", half="0.5",
)
CURRENCY = {"$": "USD", "₩": "KRW", "€": "EUR", "£": "GBP", "¥": "JPY"}
#: Seconds of a unit; a year is 365.25 days and a month a twelfth of it.
SECONDS = {"s": 1, "mi": 60, "h": 3600, "d": 86_400, "w": 604_800, "mo": 2_629_800, "y": 31_557_600}
#: The forms of money, durations, counts and dates that slots are read from.
MONEY = r"([\$₩€£¥])\s?([0-9][0-9,]*(?:\.[0-9]+)?)"
DURATION = r"(?i)\b(\d+(?:\.\d+)?)\s+(seconds?|secs?|minutes?|mins?|hours?|hrs?|days?|weeks?|wks?|months?|years?|yrs?)\b"
COUNT = r"(?i)\b(\d+)\s+(items?|things?|projects?|kits?|times?|visits?|appointments?|sessions?|trips?|movies?|films?|episodes?|books?|stories?|recipes?)\b"
MONTHS = "January February March April May June July August September October November December".split()
WEEKDAYS = ["mon", "tue", "wed", "thu", "fri", "sat", "sun"]
DATE = (
    r"(?i)\b(yesterday|today|tomorrow|(?:last|next|this)\s+(?:Mon|Tues?|Wed(?:nes)?|Thurs?|Fri|Sat(?:ur)?|Sun)(?:day)?"
    r"|\d+\s+(?:day|week|month|year)s?\s+(?:ago|later|from\s+now)"
    rf"|(?:on\s+|in\s+)?(?:{'|'.join(MONTHS)})\s+\d{{1,2}}(?:st|nd|rd|th)?(?:,\s*\d{{4}})?"
    r"|\d{4}[/\-]\d{1,2}[/\-]\d{1,2})\b"
)


def digits(text: Column) -> Column:
    """Number words as digits, in one pass over the words of a text; most texts hold none."""
    table = F.create_map(*[F.lit(x) for kv in NUMBERS.items() for x in kv])
    parts = F.transform(F.split(text, r"\b", -1), lambda w: F.coalesce(F.try_element_at(table, F.lower(w)), w))
    return F.when(text.rlike(rf"(?i)\b(?:{'|'.join(NUMBERS)})\b"), F.array_join(parts, "")).otherwise(text)


SPANS = "array<struct<raw:string,start:int>>"


def spans(text: Column, pattern: str) -> Column:
    """array<struct<raw, start>>: all matches, with their place in characters.

    Matches and the parts between them alternate, so a match starts after all
    parts up to it and all matches before it. Texts are cut only if they match.
    """

    def placed(raws: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))

        def step(acc: Column, x: Column) -> Column:
            at = acc["at"] + F.length(x["part"])
            one = F.array(F.struct(x["raw"].alias("raw"), at.alias("start")))
            return F.struct((at + F.length(x["raw"])).alias("at"), F.concat(acc["out"], one).alias("out"))

        parts = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(raws))
        pairs = F.zip_with(raws, parts, lambda raw, part: F.struct(raw.alias("raw"), part.alias("part")))
        return F.when(F.size(raws) > 0, F.aggregate(pairs, zero, step, lambda s: s["out"])).otherwise(F.array().cast(SPANS))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def _slot(kind: str, value: Column, unit: Column, span: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), value.cast("double").alias("value"), unit.alias("unit"), span["raw"].alias("raw"), span["start"].alias("start"))


def currency_slots(text: Column) -> Column:
    """Money in minor units, but whole won and yen."""

    table = F.create_map(*[F.lit(x) for kv in CURRENCY.items() for x in kv])

    def one(s: Column) -> Column:
        unit = F.try_element_at(table, F.substring(s["raw"], 1, 1))
        amount = F.regexp_replace(s["raw"], r"[^0-9.]", "").cast("double")
        return _slot("currency", F.when(unit.isin("KRW", "JPY"), amount).otherwise(F.round(amount * 100)), unit, s)

    return F.transform(spans(text, MONEY), one)


def duration_slots(text: Column) -> Column:
    # a unit is known by its first letter, minutes and months by two
    table = F.create_map(*[F.lit(x) for kv in SECONDS.items() for x in (kv[0], float(kv[1]))])

    def one(s: Column) -> Column:
        part = F.split(F.lower(s["raw"]), r"\s+", 2)
        unit = F.get(part, 1)
        seconds = F.coalesce(F.try_element_at(table, F.substring(unit, 1, 2)), F.try_element_at(table, F.substring(unit, 1, 1)))
        return _slot("duration", F.get(part, 0).cast("double") * seconds, F.lit("seconds"), s)

    return F.transform(spans(text, DURATION), one)


def count_slots(text: Column) -> Column:
    return F.transform(spans(text, COUNT), lambda s: _slot("count", F.get(F.split(s["raw"], r"\s+", 2), 0), F.lit("items"), s))


def resolved_date(phrase: Column, anchor: Column) -> Column:
    """The day a phrase means, against the anchor's day; null if it is none.

    The first character or word tells which of the five forms a phrase has.
    """
    today = F.to_date(F.timestamp_millis(anchor))

    def counted(low: Column) -> Column:
        part = F.split(low, r"\s+", 3)
        n = F.get(part, 0).try_cast("int") * F.when(low.endswith("ago"), -1).otherwise(1)
        unit = F.substring(F.get(part, 1), 1, 1)
        return (
            F.when(unit == "d", F.date_add(today, n)).when(unit == "w", F.date_add(today, n * 7))
            .when(unit == "m", F.add_months(today, n)).when(unit == "y", F.add_months(today, n * 12))
        )

    def of_week(low: Column) -> Column:
        # Monday is 0; "this" means the coming one, today included, "next" a later one, "last" an earlier one
        day = F.array_position(F.array(*map(F.lit, WEEKDAYS)), F.substring(F.get(F.split(low, r"\s+", 2), 1), 1, 3)) - 1
        ahead = F.pmod(day - F.weekday(today), F.lit(7)).cast("int")
        return (
            F.when(low.startswith("last"), F.date_sub(today, F.when(ahead == 0, 7).otherwise(7 - ahead)))
            .when(low.startswith("next"), F.date_add(today, F.when(ahead == 0, 7).otherwise(ahead)))
            .otherwise(F.date_add(today, ahead))
        )

    def of_month(low: Column) -> Column:
        month = F.array_position(F.array(*[F.lit(m.lower()) for m in MONTHS]), F.regexp_extract(low, r"^[a-z]+", 0))
        year = F.coalesce(F.regexp_extract(low, r",\s*(\d{4})$", 1).try_cast("int"), F.year(today))
        day = F.regexp_extract(low, r"^[a-z]+\s+(\d{1,2})", 1)
        return F.when(month > 0, F.try_to_date(F.concat_ws("-", year, month, day), "y-M-d"))

    def day_of(low: Column) -> Column:
        return (
            F.when(low.rlike(r"^\d{4}[/-]"), F.try_to_date(F.translate(low, "/", "-"), "y-M-d"))
            .when(low.rlike(r"^\d"), let(low, counted))
            .when(low == "yesterday", F.date_sub(today, 1)).when(low == "today", today).when(low == "tomorrow", F.date_add(today, 1))
            .when(low.rlike("^(?:last|next|this)"), of_week(low)).otherwise(of_month(low))
        )

    return let(F.regexp_replace(F.lower(phrase), r"^(?:on|in)\s+", ""), day_of)


def date_slots(text: Column, anchor: Column) -> Column:
    """Days as epoch milliseconds of their midnight in UTC."""

    def one(s: Column) -> Column:
        return _slot("event_date", F.unix_date(resolved_date(s["raw"], anchor)).cast("long") * DAY, F.lit("epoch_ms"), s)

    return F.filter(F.transform(spans(text, DATE), one), lambda x: x["value"].isNotNull())


def slots(text: Column, anchor: Column) -> Column:
    """All slots of the text with number words as digits, by place."""

    def all_of(t: Column) -> Column:
        every = F.concat(currency_slots(t), duration_slots(t), count_slots(t), F.when(anchor.isNull(), F.array().cast("array<struct<kind:string,value:double,unit:string,raw:string,start:int>>")).otherwise(date_slots(t, anchor)))
        return F.array_sort(every, lambda a, b: a["start"] - b["start"])

    return let(digits(text), all_of)


# ---- secrets ------------------------------------------------------------------

#: Prefixes of keys and the least length of a whole key.
SECRETS = [("github_pat_", 20), ("sk-proj-", 12), ("xoxb-", 12), ("ghp_", 12), ("gho_", 12), ("AKIA", 16), ("AIza", 16), ("sk-", 12)]
SECRET = r"(?<![A-Za-z0-9_-])(?:" + "|".join(f"{p}[A-Za-z0-9_-]{{{n - len(p)},}}" for p, n in SECRETS) + ")"


def secrets(text: Column) -> Column:
    return spans(text, SECRET)


def redacted(text: Column, labels: dict[str, str] | None = None) -> Column:
    """Each secret as its label; more patterns by label may be given."""
    out = F.regexp_replace(text, SECRET, "[secret]")
    for label, pattern in (labels or {}).items():
        out = F.regexp_replace(out, pattern, f"[{label}]")
    return out


def screened(rows: DataFrame, policy: str, text: str = "content") -> tuple[DataFrame, DataFrame]:
    """(rows that pass, rows held back) under report, redact or block."""
    found = F.size(secrets(F.col(text)))
    rows = rows.withColumn("n_secrets", found)
    if policy == "block":
        return rows.where("n_secrets = 0"), rows.where("n_secrets > 0")
    if policy == "redact":
        rows = rows.withColumn(text, redacted(F.col(text)))
    return rows, rows.where(F.lit(False))


def merged_spans(found: Column) -> Column:
    """Spans (start, end, label) without overlaps: the earlier stays, but a
    secret replaces what it overlaps."""
    rank = lambda s: F.when(s["label"] == "secret", 0).otherwise(1)
    keyed = F.transform(found, lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s["end"].alias("end"), F.lower(s["label"]).alias("label")))
    empty = F.array().cast("array<struct<start:int,rank:int,end:int,label:string>>")

    def step(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        clash = (F.size(acc) > 0) & (s["start"] < last["end"])
        swap = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(s))
        return F.when(~F.coalesce(clash, F.lit(False)), F.concat(acc, F.array(s))).when(s["rank"] < last["rank"], swap).otherwise(acc)

    ordered = F.sort_array(F.filter(keyed, lambda s: (s["start"] < s["end"]) & (F.trim(s["label"]) != "")))
    return F.aggregate(ordered, empty, step)


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def edited(text: Column, append: str | None = None, prepend: str | None = None, replace: tuple[str, str] | None = None, whole: str | None = None) -> Column:
    """Exactly one edit of a text."""
    if sum(x is not None for x in (append, prepend, replace, whole)) != 1:
        raise ValueError("give exactly one of append, prepend, replace and whole")
    if append is not None:
        return F.concat(text, F.lit(append))
    if prepend is not None:
        return F.concat(F.lit(prepend), text)
    return F.replace(text, F.lit(replace[0]), F.lit(replace[1])) if replace is not None else F.lit(whole)


def chunks(text: Column, target: int) -> Column:
    """Sentences packed greedily into pieces of up to ``target`` characters."""
    def step(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        fits = (F.size(acc) > 0) & (F.length(last) + 1 + F.length(s) <= target)
        joined = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat(last, F.lit(" "), s)))
        return F.when(F.coalesce(fits, F.lit(False)), joined).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(sentences(text), F.array().cast("array<string>"), step)


# ---- decisions in dialogue ------------------------------------------------------

#: Patterns of lines that state a fact, with weight and type.
DECISIONS = [
    (r"(?i)\b(?:decision|결정|결론)\s*[:：]\s*(.+)", 0.95, "decision"),
    (r"(?i)(?:✅|☑️|☑)?\s*\[?decided\]?\s*[:：-]\s*(.+)", 0.9, "decision"),
    (r"(?i)\bwe\s+(?:decided|agreed|settled\s+on)\s+(?:to\s+|that\s+)?(.+)", 0.85, "decision"),
    (r"(?i)\b(?:convention|규칙|규약)\s*[:：]\s*(.+)", 0.9, "convention"),
    (r"(?i)(.+?)\s*(?:하기로\s*(?:했|정했|결정했|합의했)|로\s*결정했|로\s*확정)", 0.85, "decision"),
    (r"(?i)^\s*(?:always|never)\s+(.+)", 0.7, "convention"),
]
ROLE = r"(?i)^\s*(?:user|assistant|system|tool|hermes|claude|gpt|model|호출자|어시스턴트)\s*[:：]\s*"


def decisions(texts: DataFrame, text: str = "content", floor: float = 0.8) -> DataFrame:
    """(id, line, payload, fact_type, confidence): the first fitting pattern of
    each line at or above the floor; the same payload counts once per text."""
    line = F.regexp_replace(stripped(F.regexp_replace(stripped(F.col("line_text")), r"^[-*•]+", "")), ROLE, "")
    rows = texts.select("id", F.posexplode(F.split(F.col(text), r"\r\n|\n|\r", -1)).alias("line", "line_text"))
    rows = rows.select("id", "line", stripped(line).alias("s")).where(F.length("s") >= 12)
    hit = F.lit(None).cast("struct<payload:string,fact_type:string,confidence:double>")
    for pattern, weight, kind in reversed([x for x in DECISIONS if x[1] >= floor]):
        payload = F.regexp_replace(F.regexp_extract("s", pattern, 1), "^[ .,;:\"']+|[ .,;:\"']+$", "")
        fits = F.col("s").rlike(pattern) & F.length(payload).between(12, 200)
        hit = F.when(fits, F.struct(payload.alias("payload"), F.lit(kind).alias("fact_type"), F.lit(weight).alias("confidence"))).otherwise(hit)
    rows = rows.withColumn("hit", hit).where("hit IS NOT NULL").select("id", "line", "hit.*")
    key = F.regexp_replace(F.regexp_replace(F.regexp_replace("payload", r"[`*_~]+", ""), r"\s+", " "), "^[ .,;:!?\"']+|[ .,;:!?\"']+$", "")
    firsts = rows.groupBy("id", F.lower(key).alias("key")).agg(F.min(F.struct("line", "payload", "fact_type", "confidence")).alias("x"))
    return firsts.select("id", "x.*")


# ---- time windows in questions --------------------------------------------------

#: Words for small numbers.
SMALL = dict(a="1", an="1", one="1", two="2", three="3", four="4", five="5", six="6", seven="7", eight="8", nine="9", ten="10", couple="2", few="3")


def question_window(question: Column, anchor: Column) -> Column:
    """struct<start, until> in days for phrases such as ``last Monday``, ``three
    weeks ago``, ``between .. and ..``, ``last two months``, ``in May 2023``; the
    first of them in this order that fits, else null. Months count 30 days,
    years 365."""
    low = F.lower(question)
    day = F.to_date(anchor)
    number = lambda s: F.coalesce(s.try_cast("int"), F.create_map(*[F.lit(x) for kv in SMALL.items() for x in kv])[s].cast("int"))
    unit = lambda s: F.when(s == "day", 1).when(s == "week", 7).when(s == "month", 30).when(s == "year", 365)
    pair = lambda a, b: F.struct(a.alias("start"), b.alias("until"))
    weekday = F.regexp_extract(low, r"last\s+(monday|tuesday|wednesday|thursday|friday|saturday|sunday|weekend)", 1)
    index = F.lit(None).cast("int")
    for i, name in enumerate(["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]):
        index = F.when(weekday == name, F.lit(i)).otherwise(index)
    index = F.when(weekday == "weekend", 5).otherwise(index)
    back = F.pmod(F.weekday(day) - index, F.lit(7))
    on = F.date_sub(day, F.when(back == 0, 7).otherwise(back))
    ago = r"(\d+|[a-z]+)\s+(day|week|month|year)s?\s+ago"
    span = number(F.regexp_extract(low, ago, 1)) * unit(F.regexp_extract(low, ago, 2))
    slack = F.greatest(F.ceil(span * 0.25).cast("int"), F.lit(3))
    center = F.date_sub(day, span)
    between = r"(?:between|from)\s+(\d{4}[/-]\d{1,2}[/-]\d{1,2})\s+(?:and|to)\s+(\d{4}[/-]\d{1,2}[/-]\d{1,2})"
    ends = [F.try_to_date(F.replace(F.regexp_extract(low, between, k), F.lit("/"), F.lit("-")), "y-M-d") for k in (1, 2)]
    recent = r"(?:last|past|previous)\s+(\d+|[a-z]+)\s+(day|week|month|year)s?"
    width = number(F.regexp_extract(low, recent, 1)) * unit(F.regexp_extract(low, recent, 2))
    named = rf"in\s+({'|'.join(m.lower() for m in MONTHS)})\s+(\d{{4}})"
    month = F.lit(None).cast("int")
    for i, name in enumerate(MONTHS):
        month = F.when(F.regexp_extract(low, named, 1) == name.lower(), F.lit(i + 1)).otherwise(month)
    first = F.try_to_date(F.concat_ws("-", F.regexp_extract(low, named, 2), month), "y-M")
    return F.coalesce(
        F.when(index.isNotNull(), pair(F.date_sub(on, 2), F.date_add(on, 2))),
        F.when(span.isNotNull(), pair(F.date_sub(center, slack), F.date_add(center, slack))),
        F.when(ends[0].isNotNull() & ends[1].isNotNull(), pair(F.date_sub(F.least(*ends), 1), F.date_add(F.greatest(*ends), 1))),
        F.when(width.isNotNull(), pair(F.date_sub(day, width + 1), day)),
        F.when(first.isNotNull(), pair(F.date_sub(first, 1), F.date_add(F.add_months(first, 1), 1))),
    )


# ---- messages that begin a workflow ------------------------------------------------

#: Words that announce a ticket, and the ways a message names its namespace.
TRIGGER = r"(?i)\b(issue|ticket|pr|pull request|automation trigger)\b"
NAMESPACE_QUOTED = r"(?is)\bsource[_ -]?id\b.{0,80}?[\"'`]([^\"'`]+)[\"'`]"
NAMESPACE = r"(?i)\bsource[_ -]?id\b\s*[:=]\s*([A-Za-z0-9_.:/#-]+)"


def workflow_of(message: Column, title: str = "workflow", limit: int = 160) -> Column:
    """struct<is_trigger, title, namespace>: the title is the first line with text, the
    namespace is quoted or follows a colon or equals sign; null if none is named."""
    lines = F.filter(F.transform(F.split(message, r"\r\n|\n|\r", -1), stripped), lambda x: x != "")
    quoted, plain = F.regexp_extract(message, NAMESPACE_QUOTED, 1), F.regexp_extract(message, NAMESPACE, 1)
    named = F.when(quoted != "", quoted).when(plain != "", plain)
    return F.struct(message.rlike(TRIGGER).alias("is_trigger"), F.coalesce(F.substring(F.get(lines, 0), 1, limit), F.lit(title)).alias("title"), named.alias("namespace"))

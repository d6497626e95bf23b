"""Problem 8: sentences of every text, whatever its language, script and punctuation.

Unsupervised sentence boundary detection: counts over the whole corpus tell, per language and by
log-likelihood ratios, which types are abbreviations, which words begin sentences and which pairs
around a stop are collocations; each stop is then classified with these statistics. Counting is
one distributed pass and SQL aggregates; the model is a written table that the workers read, so
nothing about the corpus passes through the driver."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.fs as pafs
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fotarium.session import materialize, only, spread

# Punctuation by role.
OPEN = {"(": ")", "[": "]", "{": "}", "（": "）", "［": "］", "【": "】", "《": "》", "〈": "〉", "「": "」", "『": "』", "“": "”", "„": "“", "«": "»", "‹": "›", "‘": "’", "‚": "‘", "»": "«"}
BRACKETS = set("([{（［【《〈")
QUOTES = set("“”„«»‹›「」『』‘’‚\"")
CLOSERS = set(")]}）］】》〉」』”»›’'\"*_")
ALWAYS = "!?！？。｡।॥؟۔։።፧៖។။‼⁇⁈⁉"
STOP = rf"[.…．{ALWAYS}]"
PARTICLES = "とはがをにでのもや"  # Japanese ones that go on after a quote
#: Log-likelihood ratio at which a pair or a starter counts as established (chi-square, 0.5 %).
SURE = 7.88
#: Score from which a type counts as an abbreviation.
ABBREVIATION = 0.3
#: Words, types and pairs that make up less than this share of a language's events of their kind are left
#: out of the model, which every worker loads: at most 1 / MODEL_SHARE rows a language and kind.
MODEL_SHARE = 1e-6
#: Followers of a type from which a language's own pairs count instead of those of all languages.
KNOWN = 5

_BLANK_LINE = re.compile(r"(?:\r\n|[\r\n \u0085])[^\S\r\n]*(?:\r\n|[\r\n \u0085])\s*| \s*")
_STOPS = regex.compile(rf"(?:{STOP})+|(?<=\p{{Greek}})[;;]")
_PERIOD = re.compile(r"(?<![.\s])\.(?=[\s\"”’»)\]}*_]|$)")
_THAI_BLANK = regex.compile(r"\s+")
_WORD = regex.compile(r"\p{Han}|[\p{Hiragana}\p{Katakana}ー]|[\p{L}\p{M}\p{N}](?:[\p{L}\p{M}\p{N}'’]|[.,:/_~\-](?=[\p{L}\p{N}]))*")
_CJK = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}ー]")
_SIGN = regex.compile(r"[^\p{L}\p{M}\p{N}\s]")
_CUT = regex.compile(r"""[(\[{"“„«—–=|（「《\p{Han}\p{Hiragana}\p{Katakana}ー]""")
_THAI = re.compile("[\u0e00-\u0e7f]")
_FILE = re.compile(r"^[^\W_](?:[\w~/-]*\.)+[A-Za-z][A-Za-z0-9]{1,5}$")
_LETTERS = regex.compile(r"^(?:\p{L}\p{M}*\.)+\p{L}\p{M}*$")
_NUMBER = re.compile(r"^\d[\d.,:/-]*$")
_CLITIC = re.compile(r"['’](?:s|ll|d|ve|re|m)$")
_DIGITS = re.compile(r"\d+")


def kind_of(word: str) -> str:
    """The type of a word: composed, lower-case, with numbers, file names and digits in words generalised."""
    return _kind_of(word) if len(word) <= 80 else _kind_of.__wrapped__(word)  # long ones would fill the cache


@lru_cache(maxsize=100_000)
def _kind_of(word: str) -> str:
    if not word.isascii():
        word = unicodedata.normalize("NFC", word)
    if _NUMBER.match(word):
        return "##number##"
    if "." in word and _FILE.match(word) and not _LETTERS.match(word):
        return "##file##"
    return _DIGITS.sub("#", _CLITIC.sub("", word.lower().replace("’", "'")))


def case_of(word: str) -> str:
    """U, L, D (digit) or X (a script without case, or no letter) of the first character."""
    c = word[:1]
    return "D" if c.isdigit() else "U" if c.isupper() or c.istitle() else "L" if c.islower() else "X"


def word_at(text: str, at: int, end: int) -> tuple[str, str, int]:
    """(case + type, mark, place) of the first word from `at`: the mark is what precedes it other than
    white space; in scripts without blanks the word is up to three characters, with digits generalised."""
    i, mark = at, ""
    while i < end and not (text[i].isalnum()):
        if not text[i].isspace():
            if text[i] in "＃#$€£%‰&@+=<|~^\\" or text[i] in OPEN or text[i] in CLOSERS or text[i] in "-–—•·¡¿‑―*_`":
                mark += text[i]
            else:
                return "X:" + text[i], mark, i
        i += 1
    if i >= end:
        return "", mark, end
    if _CJK.match(text, i):
        return "X:" + _DIGITS.sub("#", unicodedata.normalize("NFC", text[i : min(end, i + 9)])[:3]), mark, i
    m = _WORD.match(text, i, end)
    word = m.group() if m else text[i]
    return f"{case_of(word)}:{kind_of(word)}", mark, i


def word_before(text: str, stop: int, begin: int) -> str:
    """The run of characters before a stop that has no blank, without marks around it."""
    reach = 80
    while True:  # back to a blank or a mark that cuts, however far it is
        near = text[max(begin, stop - reach) : stop]
        token = "" if not near or near[-1].isspace() else near.split()[-1]
        if len(token) < len(near) or stop - reach <= begin or _CUT.search(token.rstrip("*_`\"”’»")):
            break
        reach *= 4
    token = token.lstrip("([{\"“„«‘'*_`（「『《【¡¿<~@#").rstrip("*_`\"”’»")
    return token if token.isalnum() and token.isascii() else _CUT.split(token)[-1]


def enclosed(text: str, begin: int, end: int) -> list[tuple[int, int]]:
    """Outermost pairs of quotes and brackets in a unit; marks without a partner don't count."""
    stack: list[tuple[str, int]] = []
    places: dict[str, list[int]] = {c: [] for c in (*OPEN, '"')}  # of each opening mark in the stack
    pairs: list[tuple[int, int]] = []

    def close(at: int, i: int) -> None:
        pairs.append((stack[at][1], i))
        for x, _ in stack[at:]:
            places[x].pop()
        del stack[at:]

    def open_(c: str, i: int) -> None:
        places[c].append(len(stack))
        stack.append((c, i))

    for m in _PAIRED.finditer(text, begin, end):
        c, i = m.group(), m.start()
        if c == '"':
            if places[c]:
                close(places[c][-1], i)
            elif i + 1 < end and not text[i + 1].isspace():
                open_(c, i)
            continue
        at = max((places[o][-1] for o in _OPENERS.get(c, ()) if places[o]), default=None)
        if c in "’‘" and at is None and c == "’":
            continue
        if c == "’" and i + 1 < end and text[i + 1].isalpha():
            continue
        if at is not None and not (c in "“«" and stack[at][0] not in "„»"):
            close(at, i)
        elif c in OPEN and not (c == "‘" and i > begin and text[i - 1].isalnum()):
            open_(c, i)
    out: list[tuple[int, int]] = []
    for a, b in sorted(pairs):
        if not out or a > out[-1][1]:
            out.append((a, b))
    return out


_OPENERS = {c: [o for o, x in OPEN.items() if x == c or (o in "„“" and c == "”")] for c in {*OPEN.values(), "”"}}
_PAIRED = re.compile("[" + re.escape("".join(sorted(set(OPEN) | set(OPEN.values()) | {'"'}))) + "]")


def units(text: str) -> Iterator[tuple[int, int]]:
    """Stretches between blank lines."""
    at = 0
    for m in _BLANK_LINE.finditer(text):
        yield at, m.start()
        at = m.end()
    yield at, len(text)


def thai(c: str) -> bool:
    return "฀" <= c <= "๿"


def _latin_or_digit(c: str) -> bool:
    return c.isdigit() or (c.isalpha() and (c < "ɐ" or "Ḁ" <= c <= "ỿ"))


class Stop:
    """A place where a sentence may end."""

    __slots__ = ("end", "kind", "left", "next", "mark", "gap", "at", "place")

    def __init__(self, place: int, end: int, kind: str, left: str, following: tuple[str, str, int], gap: str):
        self.place, self.end, self.kind, self.left, self.gap = place, end, kind, left, gap
        self.next, self.mark, self.at = following


def candidates(text: str, begin: int, end: int) -> Iterator[Stop]:
    """Every possible end in a unit, in order. Kinds: `always` (! ? and the like), `dots`, `period`,
    `quote` (after a closed quote or bracket that ends in a stop), `thai`, `blank`."""
    pairs = enclosed(text, begin, end)
    inside = iter([*pairs, (end + 1, end + 1)])
    a, b = next(inside)
    marks = [(m.start(), m.end()) for m in _STOPS.finditer(text, begin, end)]
    if _THAI.search(text, begin, end):
        for m in _THAI_BLANK.finditer(text, begin, end):
            x, y = m.start(), m.end()
            if x > begin and y < end and (thai(text[x - 1]) or thai(text[y])) and not _latin_or_digit(text[x - 1]) and not _latin_or_digit(text[y]):
                marks.append((x, -x))
        marks.sort()
    closes = []
    for p, q in pairs:
        k = q
        while k > p + 1 and (text[k - 1].isspace() or text[k - 1] in CLOSERS):
            k -= 1
        if k > p + 1 and _STOPS.match(text, k - 1, q):
            closes.append((q, p))
    opens = {p for p, _ in pairs}
    events = sorted([(s, 1, e) for s, e in marks] + [(q, 0, p) for q, p in closes])
    done = begin
    for s, is_stop, e in events:
        while s > b:
            a, b = next(inside)
        if s < done:
            continue
        if is_stop and a < s < b:
            continue
        if is_stop and e < 0:
            yield Stop(s, s, "thai", "", ("", "", s), " ")
            continue
        if is_stop:
            stop_end = e
        else:
            stop_end = s + 1
        last = stop_end
        while last < end and text[last] in CLOSERS and last not in opens:
            last += 1
        gap_end = last
        while gap_end < end and text[gap_end].isspace():
            gap_end += 1
        if gap_end > last and gap_end < end and text[gap_end] in "»›”" and gap_end not in opens:
            last = gap_end + 1
            gap_end = last
            while gap_end < end and text[gap_end].isspace():
                gap_end += 1
        done = last
        gap = text[last:gap_end]
        following = word_at(text, last, end)
        if not is_stop:
            yield Stop(s, last, "bracket" if text[e] in BRACKETS else "quote", text[e], following, gap)
            continue
        cluster = text[s:e]
        if any(c in ALWAYS or c in ";;" for c in cluster):
            kind = "always"
        elif "…" in cluster or len(cluster) > 1:
            kind = "dots"
        else:
            kind = "period"
        yield Stop(s, last, kind, word_before(text, s, begin), following, gap)


def language(code: Column) -> Column:
    """The two-letter language of a language tag however written; `und` for none."""
    short = F.lower(F.regexp_extract(F.trim(code), r"^([A-Za-z]{2})(?:[-_].*)?$", 1))
    return F.when(F.length(short) == 2, short).otherwise("und")


# --- counting -----------------------------------------------------------------------------------


def count_text(text: str, counts: Counter) -> None:
    """Add to `counts` (kind, left, right): `d` words before any single period, `s` words at
    sure starts, `p` words around a period that could end a sentence, `q` words after a closed quote
    that ends in a stop. `p` with right '' is a period at the end of a unit. (`w` and `c`, all words, are
    counted by corpus_counts().)"""
    for m in _PERIOD.finditer(text):
        left = word_before(text, m.start(), 0)
        if left:
            counts["d", kind_of(left), ""] += 1
    for begin, end in units(text):
        first = word_at(text, begin, end)[0]
        if first:
            counts["s", first, ""] += 1
        for stop in candidates(text, begin, end):
            if stop.kind == "period" and stop.left and (stop.gap or stop.at >= end):
                counts["p", kind_of(stop.left), stop.next] += 1
            elif stop.kind == "quote" and stop.next:
                counts["q", stop.next, ""] += 1
            elif stop.kind == "always" and stop.next and not stop.next.startswith("L:") and not stop.mark:
                counts["s", stop.next, ""] += 1


def count_uses(texts: list[str], counts: Counter) -> None:
    """Add to `counts` every place at which word_at() would find a word, whether or not a sentence starts
    there: `w` words by case and type; `c` three characters from each one in scripts without blanks, and marks."""
    words, rest = Counter(), Counter()
    for text in texts:
        words.update(_WORD.findall(text))
        rest.update(_SIGN.findall(text))
        if _CJK.search(text):
            whole = unicodedata.normalize("NFC", text)
            rest.update(whole[m.start() : m.start() + 3] for m in _CJK.finditer(whole))
    for word, n in words.items():
        if not _CJK.match(word):
            counts["w", f"{case_of(word)}:{kind_of(word)}", ""] += n
    for chars, n in rest.items():
        counts["c", "X:" + _DIGITS.sub("#", chars), ""] += n


def corpus_counts(documents: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, kind, a, b, n) over all documents, each distinct event counted in its language."""
    schema = pa.schema([("lang", pa.string()), ("kind", pa.string()), ("a", pa.string()), ("b", pa.string()), ("n", pa.int64())])

    def emit(held: dict[str, Counter]) -> pa.RecordBatch:
        rows = [(lang, *key, n) for lang, counts in held.items() for key, n in counts.items()]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        for batch in batches:
            texts: dict[str, list[str]] = {}
            for code, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if t:
                    count_text(t, held.setdefault(code, Counter()))
                    texts.setdefault(code, []).append(t)
            for code, held_texts in texts.items():
                count_uses(held_texts, held[code])
            if sum(map(len, held.values())) > 200_000:
                yield emit(held)
                held = {}
        yield emit(held)

    rows = documents.select(language(F.col(lang)).alias("lang"), F.col(text).cast("string").alias("text"))
    counted = rows.mapInArrow(run, "lang string, kind string, a string, b string, n bigint")
    return counted.groupBy("lang", "kind", "a", "b").agg(F.sum("n").alias("n"))


def _log_part(k: Column, n: Column, p: Column) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - 1e-12)), F.lit(1e-12))
    return k * F.log(q) + (n - k) * F.log(1 - q)


def pair_ratio(k: Column, n: Column, k0: Column, n0: Column) -> Column:
    """Twice the log-likelihood ratio that k of n and k0 of n0 have different rates."""
    both = (k + k0) / (n + n0)
    return 2 * (_log_part(k, n, k / n) + _log_part(k0, n0, k0 / n0) - _log_part(k, n, both) - _log_part(k0, n0, both))


def learn(counts: DataFrame) -> DataFrame:
    """The model as rows (lang, kind, a, b, value), for every language and for all together (`*`).

    `abbr`: types with their abbreviation score (from ABBREVIATION on); `low`, `dig`: types that
    lower case follows at least half of the time, or digits far more often than they start
    sentences; `start`: words that follow sure ends significantly more often than they are used, with
    their share of all sure starts; `used`: the uses of these words in every language; `begin`: that share of every word that began more than one; `own`: of the lower-case ones, the share of their uses; `known`: types with enough followers;
    `pair`: types
    and next words that follow a period of the type far more often than they start sentences;
    `said`: words that follow closed quotes far more often than they start sentences."""
    every = counts.withColumn("lang", F.lit("*")).groupBy("lang", "kind", "a", "b").agg(F.sum("n").alias("n"))
    counts = materialize(counts.unionByName(every), "sentence-counts")
    ended, starts, around, quoted = (counts.filter(F.col("kind") == k) for k in "dspq")
    placed = counts.filter(F.col("kind").isin("w", "c")).groupBy("lang", "a").agg(F.sum("n").alias("used"))
    words = counts.filter(F.col("kind") == "w").groupBy("lang", F.expr("substring(a, 3)").alias("a")).agg(F.sum("n").alias("n"))
    kind, held = F.col("kind"), lambda test: F.sum(F.when(test, F.col("n")).otherwise(0))
    totals = counts.groupBy("lang").agg(
        held(kind == "w").alias("all_n"), held(kind.isin("w", "c")).alias("all_used"), held(kind == "d").alias("stops"), held(kind == "s").alias("all_s"), held((kind == "s") & F.startswith("a", F.lit("D:"))).alias("dig_s"),
        (held((kind == "p") & (F.col("b") == "")) / F.nullif(held(kind == "p"), F.lit(0))).alias("last"), held(kind == "q").alias("all_q"),
    )
    totals = materialize(totals.coalesce(1), "sentence-totals")  # a row a language code: less than 700
    dots = around.groupBy("lang", "a").agg(
        F.sum("n").alias("dot"), F.sum(F.when(F.startswith("b", F.lit("L:")), F.col("n")).otherwise(0)).alias("low"),
        F.sum(F.when(F.startswith("b", F.lit("D:")), F.col("n")).otherwise(0)).alias("dig"), F.sum(F.when(F.col("b") != "", F.col("n")).otherwise(0)).alias("more"),
    )
    types = dots.join(words.select("lang", "a", F.col("n").alias("uses")), ["lang", "a"], "left").join(ended.select("lang", "a", F.col("n").alias("before")), ["lang", "a"], "left").join(F.broadcast(totals), "lang").filter(F.col("dot") >= MODEL_SHARE * F.col("stops"))
    types = materialize(types, "sentence-types")  # read by six of the tables below
    before = F.greatest(F.coalesce("before", F.lit(0)), F.col("dot")).cast("double")
    uses = F.greatest(F.coalesce("uses", F.lit(0)).cast("double"), before)
    base = F.col("stops") / F.greatest(F.col("all_n"), F.col("stops"))
    letters = F.length(F.regexp_replace("a", r"\.", "")).cast("double")
    ratio = 2 * (_log_part(before, uses, F.lit(0.99)) - _log_part(before, uses, base))
    score = ratio * F.exp(-letters) * (1 + F.length("a") - letters) * F.pow(letters, before - uses)
    plain = ~F.col("a").isin("##number##", "##file##") & F.regexp_like("a", F.lit(r"\p{L}"))
    # a word that ends units as often as others is a last word, not an abbreviation
    inside = 1 - F.col("more") / F.col("dot") <= 0.25 * F.col("last")
    abbr = types.filter(plain & inside & (letters > 0) & (score >= ABBREVIATION)).select("lang", F.lit("abbr").alias("kind"), "a", F.lit("").alias("b"), score.alias("value"))
    low = types.filter(plain & (F.col("dot") >= 3) & (F.col("low") >= 0.5 * F.col("dot"))).select("lang", F.lit("low").alias("kind"), "a", F.lit("").alias("b"), (F.col("low") / F.col("dot")).alias("value"))
    k, n, k0, n0 = (F.coalesce(F.col(c), F.lit(0)).cast("double") for c in ("dig", "more", "dig_s", "all_s"))
    often = (n > 0) & (k / n > 3 * k0 / F.greatest(n0, F.lit(1.0))) & (pair_ratio(k, n, k0, F.greatest(n0, F.lit(1.0))) >= SURE)
    dig = types.filter(plain & (F.col("dot") >= 3) & often).select("lang", F.lit("dig").alias("kind"), "a", F.lit("").alias("b"), (F.col("dig") / F.col("dot")).alias("value"))
    begun = materialize(starts.join(F.broadcast(totals), "lang").filter(F.col("n") >= MODEL_SHARE * F.col("all_s")).select("lang", F.col("a").alias("word"), F.col("n").alias("s"), "all_s", "all_used"), "sentence-starts")
    share = F.col("s") / F.col("all_s")
    begin = begun.filter(F.col("s") >= 2).select("lang", F.lit("begin").alias("kind"), F.col("word").alias("a"), F.lit("").alias("b"), share.alias("value"))
    k, n, k0 = F.col("s").cast("double"), F.col("all_s").cast("double"), F.greatest(F.coalesce("used", F.lit(0)), F.col("s")).cast("double")
    n0 = F.greatest(F.col("all_used"), F.col("all_s")).cast("double")
    start = begun.join(placed.withColumnRenamed("a", "word"), ["lang", "word"], "left").filter((k / n > k0 / n0) & (pair_ratio(k, n, k0, n0) >= SURE))
    start = materialize(start, "sentence-starters")
    used = placed.join(start.select(F.col("word").alias("a")).distinct(), "a").select("lang", F.lit("used").alias("kind"), "a", F.lit("").alias("b"), F.col("used").cast("double").alias("value"))
    start = start.select("lang", F.lit("start").alias("kind"), F.col("word").alias("a"), F.lit("").alias("b"), share.alias("value"))
    lower = begun.filter(F.startswith("word", F.lit("L:")) & (F.col("s") >= 3)).withColumn("a", F.expr("substring(word, 3)"))
    lower = lower.join(words.select("lang", "a", "n"), ["lang", "a"]).select("lang", F.lit("own").alias("kind"), F.col("word").alias("a"), F.lit("").alias("b"), F.least(F.lit(1.0), F.col("s") / F.col("n")).alias("value"))
    # only types that can be in doubt need their pairs: abbreviations, numbers, initials
    doubt = abbr.select("lang", "a").union(low.select("lang", "a")).union(dig.select("lang", "a")).union(types.filter((F.col("a") == "##number##") | F.regexp_like("a", F.lit(r"^(\p{L}\p{M}*\.)*\p{L}\p{M}*$"))).select("lang", "a"))
    doubt = types.select("lang", "a", "more", "all_s", "stops").join(doubt.select("a").distinct(), "a")  # doubtful in one language: judged in each
    doubt = materialize(doubt, "sentence-doubt")
    known = doubt.filter(F.col("more") >= KNOWN).select("lang", F.lit("known").alias("kind"), "a", F.lit("").alias("b"), F.col("more").cast("double").alias("value"))
    pairs = around.filter(F.col("b") != "").join(doubt, ["lang", "a"]).join(begun.select("lang", F.col("word").alias("b"), "s"), ["lang", "b"], "left")
    k0, n0 = F.coalesce("s", F.lit(0)).cast("double"), F.greatest(F.coalesce("all_s", F.lit(1)), F.lit(1)).cast("double")
    rate, rate0 = F.col("n") / F.col("more"), k0 / n0
    pair = pairs.filter((F.col("n") >= 2) & (F.col("n") >= MODEL_SHARE * F.col("stops")) & (rate > 3 * rate0) & (pair_ratio(F.col("n").cast("double"), F.col("more").cast("double"), k0, n0) >= SURE)).select("lang", F.lit("pair").alias("kind"), "a", "b", rate.alias("value"))
    after = quoted.select("lang", F.col("a").alias("word"), F.col("n").alias("q")).join(F.broadcast(totals), "lang").join(begun.select("lang", "word", "s"), ["lang", "word"], "left")
    said_rate = F.col("q") / F.col("all_q")
    said = after.filter((F.col("q") >= 2) & (said_rate >= MODEL_SHARE) & (said_rate > 3 * rate0) & (pair_ratio(F.col("q").cast("double"), F.col("all_q").cast("double"), k0, n0) >= SURE)).select("lang", F.lit("said").alias("kind"), F.col("word").alias("a"), F.lit("").alias("b"), said_rate.alias("value"))
    out = abbr
    for part in (low, dig, begin, start, used, lower, known, pair, said):
        out = out.unionByName(part)
    return out


# --- classifying ----------------------------------------------------------------------------------


class Model:
    """The learned tables of one language, with those of all languages behind them."""

    def __init__(self, own: dict[str, dict], corpus: Corpus):
        self.own, self.pooled, self.corpus = own, corpus.pooled, corpus

    def has(self, kind: str, *key: str) -> bool:
        key = key if len(key) == 2 else (*key, "")
        return key in self.own.get(kind, ()) or key in self.pooled.get(kind, ())

    def of(self, left: str) -> dict[str, dict]:
        """The tables that judge a type before a stop: the language's own, unless most uses of the type
        are in another language, whose tables then decide (a foreign passage)."""
        own, every = self.own.get("known", {}).get((left, ""), 0.0), self.pooled.get("known", {}).get((left, ""), 0.0)
        if own and own >= 0.1 * every or (left == "##number##" and own >= 10 * KNOWN):
            return self.own
        return self.corpus.tables.get(self.corpus.home.get(left, "*"), {})

    def type(self, kind: str, left: str) -> bool:
        return (left, "") in self.of(left).get(kind, ())

    def pair(self, left: str, right: str) -> bool:
        """Whether the two around a stop are a collocation. Numbers belong to no language: there the
        one in which the next word begins sentences decides."""
        held = self.corpus.tables.get(self.corpus.begins.get(right)) if left == "##number##" else None
        return (left, right) in (held or self.of(left)).get("pair", ())

    def value(self, kind: str, key: str) -> float:
        return max(self.own.get(kind, {}).get((key, ""), 0.0), self.pooled.get(kind, {}).get((key, ""), 0.0))


class Corpus:
    """The model table by language, with the language in which each type and starter is at home."""

    def __init__(self, tables: dict[str, dict[str, dict]]):
        self.tables, self.pooled = tables, tables.get("*", {})
        self.home, self.begins, self.used = self._homes("known"), self._homes("begin"), self._homes("used")
        self.models = {code: Model(held, self) for code, held in tables.items() if code not in ("*", "und")}
        self.plain = Model({}, self)

    def _homes(self, kind: str) -> dict[str, str]:
        most: dict[str, tuple[float, str]] = {}
        for code, held in self.tables.items():
            if code not in ("*", "und"):
                for (key, _), value in held.get(kind, {}).items():
                    most[key] = max(most.get(key, (0.0, "")), (value, code))
        return {key: code for key, (_, code) in most.items()}

    def model(self, code: str, text: str) -> Model:
        """The model of the language a text is tagged with, or, if the words that begin its units are
        at home in another one at least twice as often, of that one."""
        votes = Counter(self.begins.get(word_at(text, begin, end)[0]) for begin, end in units(text))
        votes.pop(None, None)
        best = max(sorted(votes), key=votes.get, default=code)
        if code in self.models and 2 * votes[code] >= votes[best]:
            return self.models[code]
        return self.models.get(best, self.models.get(code, self.plain))


def sentence_ends(text: str, begin: int, end: int, model: Model) -> Iterator[int]:
    """The ends of the sentences of a unit but the last one's."""
    opened = begin
    for stop in candidates(text, begin, end):
        if stop.at >= end and stop.kind != "thai":
            continue
        if stop.kind == "period" and stop.place - len(stop.left) < opened:  # the word began before a missing blank
            stop.left = word_before(text, stop.place, opened)
        if _ends(text, stop, opened, model):
            yield stop.end
            opened = stop.end


def _starts(model: Model, word: str) -> bool:
    """Whether a word is a starter of the language or, if most uses of the word are in another one, of that one."""
    own, every = (held.get("used", {}).get((word, ""), 0.0) for held in (model.own, model.pooled))
    held = model.own if own and own >= 0.1 * every else model.corpus.tables.get(model.corpus.used.get(word, "*"), {})
    return (word, "") in held.get("start", ())


def _ends(text: str, stop: Stop, opened: int, model: Model) -> bool:
    if stop.kind == "thai":
        return True
    following = text[stop.end : stop.end + len(stop.gap) + 1][len(stop.gap) :]
    if following and following in ",;:，、；：،؛" or (following and following in ".!?…"):
        return False
    case, word = stop.next[:1], stop.next
    latest = text[stop.end - 1]
    if stop.kind in ("quote", "bracket"):
        at = opened
        while text[at].isspace():
            at += 1
        if stop.kind == "bracket" and text[at] != stop.left:
            return False
        if following in OPEN and following not in "»’" or (following == '"' and stop.gap):
            return True
        if case == "L":
            return model.has("own", word) and (stop.kind == "bracket" or model.value("own", word) >= 0.1)
        if case == "U":
            return not ("—" in stop.mark or "–" in stop.mark) or _starts(model, word)
        if case == "D":
            return True
        if stop.kind == "bracket":
            return True
        if following and following in PARTICLES:
            return False
        return not model.has("said", word) and (_starts(model, word) or not model.own.get("said"))
    if stop.kind == "always":
        if stop.gap or following in OPEN or following in "\"*_¿¡":
            return True
        if latest in "!?" and (case in "LD" or following in "=&/#-_%"):
            return False
        return True
    if stop.kind == "dots":
        lower = case == "L" and not (set(stop.mark) & BRACKETS and model.value("own", word) >= 0.1)
        return not lower and (bool(stop.gap) or case != "D" or latest == "…")
    left = stop.left
    kind = kind_of(left)
    if "．" in text[stop.end - 1 : stop.end] and not stop.gap and case == "D":
        return False
    if not stop.gap:
        if following in OPEN and left and not following.isspace() and following not in "([{":
            pass
        elif following == '"' or following in "([{*¿¡":
            pass
        elif case == "U":
            # a missing blank: a capitalised word after a word in small letters, a number or a file
            tail = text[stop.at : stop.at + 2]
            single = len(word) == 3
            if not (left[-1:].islower() or left[-1:].isdigit() or left[-1:] in ")%" or _FILE.match(left) or case_of(left[-1:]) == "X"):
                return False
            if len(left) < 2 or _LETTERS.match(left) or not (tail[1:].islower() or tail[1:] in "'’" or (single and tail[1:].isspace()) or _starts(model, word)):
                return False
        elif case == "X" and following.isalpha() and not _latin_or_digit(following):
            if _latin_or_digit(left[-1:]) and left[-1:].isalpha():
                return False
        else:
            return False
    number = kind == "##number##"
    if not left:
        return case != "L"
    # a list number or letter at the start of a sentence goes with what follows
    head = text[opened : stop.end].strip() if stop.end - opened < 40 else ""
    if (number or (len(left) == 1 and left.isalpha() and case_of(left) != "X") or re.fullmatch(r"[ivxIVX]{1,5}", left)) and head.rstrip(".").strip("([*_ ") == left and len(left) <= 4:
        return False
    letters = bool(_LETTERS.match(left))
    initial = len(left) == 1 and left.isalpha() and case_of(left) != "X" or (len(left) == 2 and case_of(left) == "X" and left[0].isalpha())
    file = kind == "##file##"
    short = letters or initial or model.type("abbr", kind)
    if letters or initial:
        after = text[stop.at : stop.at + 3]
        if len(after) >= 2 and after[0].isalpha() and after[1] == "." and case != "X" and (not after[2:].isspace() or initial):
            return False
    if case == "L":
        if number or file or short:
            return model.has("own", word) and model.value("own", word) >= 0.2 and not model.pair(kind, word)
        if model.type("low", kind):
            return model.value("own", word) >= 0.1 and not model.pair(kind, word)
        return model.has("own", word) or _starts(model, word)
    if case == "D":
        if number:
            ahead = text[stop.at : stop.at + 5]
            return not re.match(r"\d{1,2}\.|\d{4}\b", ahead) or len(left) > 2
        if short or model.type("dig", kind):
            return not (model.type("dig", kind) or initial or not model.has("begin", "D:##number##"))
        return True
    if model.pair(kind, word) and (short or number or model.type("dig", kind) or model.type("low", kind)):
        return False
    if initial and not _starts(model, word):
        return False
    if short and not _starts(model, word):
        return False
    return True


def split(text: str | None, model: Model) -> list[tuple[int, int]]:
    """(start, end) of the sentences: white space lies outside, every other character in one of them."""
    out: list[tuple[int, int]] = []
    for begin, end in units(text or ""):
        at = begin
        for cut in [*sentence_ends(text, begin, end, model), end]:
            part = text[at:cut]
            inner = part.strip()
            if inner:
                lead = len(part) - len(part.lstrip())
                out.append((at + lead, at + lead + len(inner)))
            at = cut
    return out


@lru_cache(maxsize=2)
def load_model(path: str | None) -> Corpus:
    """The model table, read once per Python worker."""
    if not path:
        return Corpus({})
    filesystem, where = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    held: dict[str, dict[str, dict]] = {}
    for batch in pads.dataset(where, filesystem=filesystem, format="parquet", exclude_invalid_files=False).to_batches():
        for r in batch.to_pylist():
            held.setdefault(r["lang"], {}).setdefault(r["kind"], {})[r["a"], r["b"]] = r["value"]
    return Corpus(held)


def sentences(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, sent_start, sent_end): one row per sentence, in code points, end exclusive.

    Null, empty and blank texts have no sentence. Each row is split on its own, so repeated rows give
    repeated sentences. Texts are split whole. Languages null or unknown use the statistics of all."""
    documents = spread(only(documents, doc_id, text, lang))
    model = materialize(learn(corpus_counts(documents, text, lang)).repartition(4), "sentence-model")
    path = model.inputFiles()
    where = path[0].rsplit("/", 1)[0] if path else None
    where = where.replace("file:///", "/") if where and where.startswith("file:///") else where
    kind = documents.schema[doc_id].dataType.simpleString()
    source = documents.select(F.col(doc_id), language(F.col(lang)).alias("_lang"), F.col(text).cast("string").alias("_text")).filter(F.length("_text") > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        corpus = load_model(where)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                starts, ends, rows = [], [], []
                for i, (code, t) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)):
                    for a, b in split(t, corpus.model(code, t)):
                        starts.append(a)
                        ends.append(b)
                        rows.append(i)
                ids = part.column(0).take(pa.array(np.array(rows, np.int64)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=[doc_id, "sent_start", "sent_end"])

    return source.mapInArrow(run, f"`{doc_id}` {kind}, sent_start int, sent_end int")

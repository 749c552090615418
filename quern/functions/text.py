"""Message tokenising, URL words, indicators and formats as columns; Java's regular expressions, no Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMOTICON = r"(?:[:;=8xX][-o^']?[)(\]\[DPpOo3/\\|]+|<3+|\^_+\^|[)(\]\[][-o^']?[:;=])(?=\s|$)"
URL = r"(?i:(?:https?|ftp)://\S+|www\.\S+)"
TIME = r"\d{1,2}:\d{2}(?::\d{2})?"
DECIMAL = r"\d+(?:\.\d+)+"
COMMA_NUMBER = r"\d{1,3}(?:,\d{3})+"
ABBREVIATION = r"(?:(?<=\s|^)\p{L}(?:\.\p{L})+\.?|(?i:mrs?|ms|dr|st|vs|etc)\.)"
INNER_APOSTROPHE = r"\p{L}+['’]\p{L}+"
PROTECTED = "|".join((URL, EMOTICON, TIME, DECIMAL, COMMA_NUMBER, ABBREVIATION, INNER_APOSTROPHE))
MARK = "\u0001"
STOP = frozenset(("a", "an", "and", "are", "as", "at", "be", "by", "for", "in", "is", "it", "of", "on", "or", "that", "the", "to", "was", "with"))


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\p{Z}\s]+", " "))


def strip_repost(text: Column) -> Column:
    return F.regexp_replace(text, r"(?:RT|via) @", "@")


def edge_punctuation(text: Column) -> Column:
    """A space between a word and the punctuation at its edges."""
    left = F.regexp_replace(text, r"(^|\s)(['\"“”‘’«»(\[{*]+)(?=\S)", "$1$2 ")
    return F.regexp_replace(left, r"(?<=\S)(['\"“”‘’»)\]}*.,;:!?…]+)(?=\s|$)", " $1")


def tokens(text: Column, keep_urls: bool = False, stop: frozenset[str] = frozenset()) -> Column:
    """Lower-case tokens. Emoticons are kept; hashtags count twice, without their sign; mentions, numbers, signs go.

    Protected spans (links, emoticons, times, numbers, abbreviations, inner apostrophes) are never split: marks are put
    around them and the parts between marks alternate, ordinary text first.
    """
    t = squeeze(strip_repost(F.coalesce(text, F.lit(""))))
    marked = F.split(F.regexp_replace(t, f"({PROTECTED})", f"{MARK}$1{MARK}"), MARK)
    plain = lambda x: F.split(F.regexp_replace(x, r"[^\p{L}\p{N}_#@\-']+|-{2,}|(?<![\p{L}\p{N}])['-]|['-](?![\p{L}\p{N}])", " "), " ")
    parts = F.flatten(F.transform(marked, lambda x, i: F.when(i % 2 == 0, plain(x)).otherwise(F.array(x))))
    url = lambda x: x.rlike(rf"\A(?:{URL})\z")
    fixed = F.transform(parts, lambda x: F.when(url(x), F.regexp_replace(x, r"(?i)^https://(t\.co|bit\.ly)/", "http://$1/")).otherwise(F.lower(x)))
    doubled = F.flatten(F.transform(fixed, lambda x: F.when(x.rlike(r"^#[\p{L}\p{N}_]+$"), F.array(F.substring(x, 2, 1_000_000), F.substring(x, 2, 1_000_000))).otherwise(F.array(x))))
    ignored = r"\A(?:@.*|[\p{P}\p{S}\W]+|\d+(?:[.,]\d+)*|)\z"
    emot = lambda x: F.concat(x, F.lit(" ")).rlike(rf"\A(?i:{EMOTICON}) \z")
    keep = lambda x: emot(x) | (url(x) if keep_urls else F.lit(False)) | (~url(x) & ~x.rlike(ignored) & (F.length(x) > 1) & (~x.isin(*stop) if stop else F.lit(True)))
    return F.filter(doubled, keep)


def url_tokens(url: Column) -> Column:
    """The words of a link: its host, its query, and the parts of its decoded path, capitals cut off, without integers. A link
    that can't be parsed or decoded has none."""
    host, query = F.try_parse_url(url, F.lit("HOST")), F.try_parse_url(url, F.lit("QUERY"))
    path = F.try_url_decode(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")))
    parts = F.split(F.lower(F.regexp_replace(path, "([A-Z])", "_$1")), r"[^\p{L}\p{N}]+")
    words = F.filter(parts, lambda x: (x != "") & ~(x.rlike("^[0-9]+$") & x.try_cast("int").isNotNull()))
    return F.when(path.isNotNull(), F.concat(F.array_compact(F.array(host, query)), words)).otherwise(F.array().cast("array<string>"))


SHORTENERS = ("t.co", "bit.ly", "goo.gl", "tinyurl.com", "ow.ly", "is.gd")


def is_short_url(url: Column, shorteners: tuple[str, ...] = SHORTENERS) -> Column:
    return url.rlike(r"^(https?://|www\.)(" + "|".join(x.replace(".", r"\.") for x in shorteners) + ")")


def emoji_pattern(lines: list[str]) -> str:
    """A regular expression of the sequences in lines of Unicode's emoji files (`1F600..1F64F ; ...`, `1F468 200D 1F469 ; ...`,
    # comments): longer sequences come first, as the longest match counts."""
    found: set[tuple[str, ...]] = set()
    for line in lines:
        line = line.split("#")[0].split(";")[0].strip()
        if ".." in line:
            a, b = line.split("..")
            found.add((a.strip(), b.strip(), "range"))
        elif line:
            found.add(tuple(line.split()))
    one = lambda x: rf"\x{{{x}}}"
    texts = [f"[{one(x[0])}-{one(x[1])}]" if x[-1] == "range" else "".join(map(one, x)) for x in sorted(found, key=lambda x: (-(1 if x[-1] == "range" else len(x)), x))]
    return "(?:" + "|".join(texts) + ")"


def emoji_segments(text: Column, pattern: str) -> Column:
    """The parts of a text: each emoji alone, the stretches between them whole."""
    return F.filter(F.split(F.regexp_replace(text, f"({pattern})", f"{MARK}$1{MARK}"), MARK), lambda x: x != "")


MENTION = r"(?:(?:RT|via) )?@([a-zA-Z0-9_]{2,15})(?:\s|$)"


def mentions(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(MENTION), F.lit(1))


def indicators(text: Column) -> Column:
    """All mentions with what leads them: @name, RT @name or via @name."""
    return F.regexp_extract_all(text, F.lit(MENTION), F.lit(0))


def is_addressive(text: Column) -> Column:
    """Starts with a mention that is no repost."""
    return text.rlike(r"^@[a-zA-Z0-9_]{2,15}(?:\s|$)")


def is_original(text: Column) -> Column:
    return ~text.rlike(r"(?:^|\s)(?:RT|via) @[a-zA-Z0-9_]{2,15}(?:\s|$)")


def csv_field(text: Column) -> Column:
    return F.translate(text, ";\n\r", "___")


def latex(text: Column) -> Column:
    return F.regexp_replace(text, r"([&%$#_{}])", r"\\$1")


def duration(seconds: Column, elements: int = 5) -> Column:
    """1y 2d 3h 4m 5s, the largest ``elements`` units; below one second: < 1s."""
    left = F.floor(seconds).cast("long")
    parts = []
    for unit, size in (("y", 31_536_000), ("d", 86_400), ("h", 3_600), ("m", 60), ("s", 1)):
        n = F.floor(left / size)
        parts.append(F.when(n > 0, F.concat(n.cast("string"), F.lit(unit))))
        left = left % size
    all_ = F.filter(F.array(*parts), lambda x: x.isNotNull())
    return F.when(seconds < 1, "< 1s").otherwise(F.array_join(F.slice(all_, 1, elements), " "))


def probability(p: Column, digits: int = 3) -> Column:
    return F.when(p >= 0.001, F.format_number(p, digits)).otherwise(F.concat(F.lit("1e"), F.round(F.log10(p)).cast("int")))


def epoch_minutes(ts: Column) -> Column:
    """Whole minutes since 2010-01-01 UTC."""
    return F.floor((F.unix_micros(ts.cast("timestamp")) / 1e6 - 1_262_304_000) / 60).cast("long")


def interval_key(start_ms: Column, days: Column) -> Column:
    """Intervals of negative length end where they start: the same key as the shifted positive one."""
    first = F.when(days < 0, start_ms + days * 86_400_000).otherwise(start_ms)
    return F.shiftleft(first, 8).bitwiseOR(F.abs(days).cast("long"))


def center_dates(end: str, weeks: int, n: int) -> Column:
    """end - i * weeks for i = 1 .. n - 1, the latest first."""
    return F.transform(F.sequence(F.lit(1), F.lit(n - 1)), lambda i: F.date_sub(F.to_date(F.lit(end)), (i * weeks * 7).cast("int")))

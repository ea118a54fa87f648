"""Scalar column functions over text, time and identity. All are built-in expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace import lexicon as L

BLANK = r"(?U)\s+"
SENTENCE_END = "(?<=[。！？!?；;])"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_blank(c) -> Column:
    """Null, NaN as text, or nothing but white space."""
    return col(c).isNull() | (F.trim(F.regexp_replace(col(c).cast("string"), BLANK, " ")) == "") | (F.lower(col(c).cast("string")) == "nan")


def clean(c) -> Column:
    """Null as empty; Unicode white space collapsed to one space and trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(col(c).cast("string"), F.lit("")), BLANK, " "))


def none_if_blank(c) -> Column:
    return F.nullif(clean(c), F.lit(""))


def parse_time(c) -> Column:
    """A timestamp from any of the usual forms, else null."""
    text = clean(c)
    forms = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd", "yyyyMMdd", "yyyy年M月d日")
    return F.coalesce(F.expr("null").cast("timestamp_ntz"), *(F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in forms))


def parse_sheet_time(c) -> Column:
    """A spreadsheet's serial day (1 to 100000, from 1899-12-30), else parse_time."""
    serial = clean(c).try_cast("double")
    day = F.timestamp_add("SECOND", F.round(serial * 86400).cast("bigint"), F.lit("1899-12-30").cast("timestamp_ntz"))
    return F.when((serial >= 1) & (serial <= 100_000), day).otherwise(parse_time(c))


def entity_name(c) -> Column:
    """The first of a list of names, without one legal form at its end."""
    first = F.element_at(F.split(clean(c), r"(?U)[,，、;/；\s]+"), 1)
    return F.trim(F.regexp_replace(first, f"({'|'.join(L.LEGAL_FORMS)})$", ""))


def contains_any(c, words: Sequence[str]) -> Column:
    """Whether a text holds one of the words; null holds none."""
    text = F.coalesce(col(c), F.lit(""))
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def first_group(c, groups: Mapping[str, Sequence[str]], otherwise) -> Column:
    """The name of the first group, in order, of which the text holds a word."""
    out = None
    for name, words in groups.items():
        found = contains_any(c, words)
        out = F.when(found, F.lit(name)) if out is None else out.when(found, F.lit(name))
    return out.otherwise(otherwise)


def polarity(c, fallback=None) -> Column:
    """A label as it is, by its synonyms, or by words of the fallback text (else its own), negative before positive."""
    text = clean(c)
    hay = text if fallback is None else F.when(F.coalesce(col(fallback), F.lit("")) != "", col(fallback)).otherwise(text)
    return (
        F.when(text.isin(L.POSITIVE, L.NEGATIVE, L.NEUTRAL), text)
        .when(F.lower(text).isin(*L.POSITIVE_NAMES), L.POSITIVE)
        .when(F.lower(text).isin(*L.NEGATIVE_NAMES), L.NEGATIVE)
        .when(contains_any(hay, L.NEGATIVE_WORDS), L.NEGATIVE)
        .when(contains_any(hay, L.POSITIVE_WORDS), L.POSITIVE)
        .otherwise(L.NEUTRAL)
    )


def model_text(title, entity, industry, source, content, chars: int = 1200) -> Column:
    """What a classifier reads: the parts that aren't blank, joined by spaces."""
    return F.concat_ws(" ", *(none_if_blank(c) for c in (title, entity, industry, source, F.substring(F.coalesce(col(content), F.lit("")), 1, chars))))


def sentences(c) -> Column:
    return F.filter(F.transform(F.split(clean(c), SENTENCE_END), lambda x: F.trim(x)), lambda s: s != "")


def evidence_sentence(content, title, event_type=None, words: Sequence[str] = (*L.NEGATIVE_WORDS, *L.POSITIVE_WORDS), chars: int = 80) -> Column:
    """The first sentence that names the event or holds a polarity word, else the first, else the title; cut."""
    all_ = sentences(content)
    kind = F.lit("") if event_type is None else F.coalesce(col(event_type), F.lit(""))
    telling = F.filter(all_, lambda s: contains_any(s, words) | ((kind != "") & F.contains(s, kind)))
    return F.substring(F.coalesce(F.get(telling, 0), F.get(all_, 0), clean(title)), 1, chars)


def tokens(c) -> Column:
    """Distinct words of two characters and more, in order of appearance."""
    return F.array_distinct(F.filter(F.split(clean(c), r"(?U)\W+"), lambda w: F.length(w) >= 2))


def compact(c) -> Column:
    """Lower-case letters, digits and ideographs alone: what names are matched by."""
    return F.regexp_replace(F.lower(clean(c)), "[^0-9a-z\\u4e00-\\u9fff]+", "")


def identifier(c, width: int | None = None) -> Column:
    """Without a float's '.0'; numbers padded with zeros to width, longer ones kept."""
    text = F.regexp_replace(clean(c), r"^(\d+)\.0$", "$1")
    return text if width is None else F.when(text.rlike(r"^\d+$") & (F.length(text) < width), F.lpad(text, width, "0")).otherwise(text)


def source_key(source, content_hash) -> Column:
    """A source's name without case and white space; blank sources are told apart by the content's hash."""
    name = F.regexp_replace(F.lower(F.coalesce(col(source), F.lit(""))), BLANK, "")
    return F.when(name != "", name).otherwise(F.concat(F.lit("unknown-"), F.substring(col(content_hash), 1, 12)))


def sampled(c, mode: str, budget: int = 2400) -> Column:
    """Part of a long text: its head; head and tail; or head, middle and tail."""
    text = F.coalesce(col(c), F.lit(""))
    n = F.length(text)
    if mode == "head":
        return F.substring(text, 1, budget)
    if mode == "head_tail":
        half = budget // 2
        return F.when(n <= budget, text).otherwise(F.concat_ws("\n", F.substring(text, 1, half), F.right(text, F.lit(budget - half))))
    if mode == "head_middle_tail":
        third = budget // 3
        middle = F.substr(text, (F.floor(n / 2) - third // 2 + 1).cast("int"), F.lit(third))
        return F.when(n <= budget, text).otherwise(F.concat_ws("\n", F.substring(text, 1, third), middle, F.right(text, F.lit(budget - 2 * third))))
    raise ValueError(f"no such mode: {mode}")


def masked(c, aliases, mask: str = "[SUBJECT]") -> Column:
    """Every alias of an array (longest first) replaced by mask; runs of masks become one."""
    text = F.aggregate(col(aliases), F.coalesce(col(c), F.lit("")), lambda acc, a: F.replace(acc, a, F.lit(mask)))
    quoted = mask.replace("[", r"\[").replace("]", r"\]")
    return F.regexp_replace(text, f"(?:{quoted}\\s*)+", mask.replace("$", r"\$"))


def packed(c) -> Column:
    """The text without white space; null as empty."""
    return F.regexp_replace(F.coalesce(col(c), F.lit("")), BLANK, "")


def char_grams(c, size: int = 2) -> Column:
    """Distinct substrings of size characters of the text without white space; a shorter text is its own."""
    text = packed(c)
    n = F.length(text)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))), lambda i: F.substr(text, i, F.lit(size)))
    return F.when(n == 0, F.array().cast("array<string>")).when(n < size, F.array(text)).otherwise(F.array_distinct(grams))


def pair_key(a, b) -> Column:
    """The two ids in order, joined."""
    return F.concat_ws("::", F.least(col(a), col(b)), F.greatest(col(a), col(b)))


def pair_hash(scope, label, left, right, left_group, right_group) -> Column:
    """A hashed id of a labelled pair, the same for either order of its ids."""
    first = col(left) <= col(right)
    ends = (F.when(first, col(left)).otherwise(col(right)), F.when(first, col(right)).otherwise(col(left)), F.when(first, col(left_group)).otherwise(col(right_group)), F.when(first, col(right_group)).otherwise(col(left_group)))
    return F.concat(F.lit("PAIR-"), F.substring(F.sha2(F.concat_ws("|", col(scope), col(label).cast("string"), *ends), 256), 1, 16))


def fingerprint(title, content) -> Column:
    """SHA-256 of the cleaned title and content."""
    return F.sha2(F.concat(clean(title), F.lit("\n"), clean(content)), 256)


def hash_rank(seed, key) -> Column:
    """A sort key that is as good as random and the same everywhere."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), col(key).cast("string")), 256)


def split_ids(c) -> Column:
    """The ids of a comma-separated list, trimmed, blanks dropped."""
    return F.filter(F.transform(F.split(F.coalesce(col(c), F.lit("")), "[,，]"), lambda x: F.trim(x)), lambda x: x != "")


def choose_two(n) -> Column:
    return col(n) * (col(n) - 1) / 2


def harmonic(p, r) -> Column:
    """F1 of precision and recall, 0 where both are."""
    return F.coalesce(F.try_divide(2 * col(p) * col(r), col(p) + col(r)), F.lit(0.0))


def merged_lists(*lists, limit: int | None = None) -> Column:
    """Ranked lists one after another, trimmed, each name where it first stands."""
    names = F.array_distinct(F.filter(F.transform(F.concat(*(F.coalesce(col(x), F.array().cast("array<string>")) for x in lists)), lambda x: F.trim(x)), lambda x: x != ""))
    return names if limit is None else F.slice(names, 1, limit)


def trigger_terms(terms, least: int = 2) -> Column:
    """Trimmed terms of at least so many characters, each once, in order."""
    return F.array_distinct(F.filter(F.transform(col(terms), lambda x: F.trim(x)), lambda t: F.length(t) >= least))


def json_action(raw) -> Column:
    """The outermost JSON object of an answer that may be fenced, as a variant; null if there is none."""
    return F.try_parse_json(F.nullif(F.regexp_extract(col(raw), r"(?s)\{.*\}", 0), F.lit("")))


def dependency(c) -> Column:
    """name:healthy, name:required_down or name:fallback as a struct; any other state raises."""
    parts = F.split(col(c), ":", 2)
    state = F.get(parts, 1)
    return F.when(
        state.isin("healthy", "required_down", "fallback") & (F.get(parts, 0) != ""),
        F.struct(F.get(parts, 0).alias("name"), (state == "healthy").alias("healthy"), F.lit(True).alias("required"), (state == "fallback").alias("fallback_available")),
    ).otherwise(F.raise_error(F.concat(F.lit("not a dependency: "), F.coalesce(col(c), F.lit("null")))).cast("struct<name:string,healthy:boolean,required:boolean,fallback_available:boolean>"))


def valid_sample(title, content, label, forbidden, least: int = 60) -> Column:
    """Whether a made-up article is usable: a title, enough content, and neither its label, a forbidden one (an array) nor a giveaway in it."""
    t, c = clean(title), clean(content)
    both = F.concat_ws(" ", t, c)
    leaks = F.contains(both, col(label)) | F.exists(F.coalesce(col(forbidden), F.array().cast("array<string>")), lambda name: F.contains(both, name)) | contains_any(both, L.GIVEAWAYS)
    return (F.length(c) >= least) & (t != "") & ~leaks

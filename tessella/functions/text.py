"""Text functions as Column expressions: normalization, extraction, token overlap.

Null texts count as empty. White space is Unicode white space.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space, written so that Java and RE2 patterns mean the same.
SPACE = r"[\t-\r\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
# Characters stripped from the ends of answers, and spellings of yes and no.
EDGE = "\"'`.,;:!?()[]{}"
YES, NO = ["yes", "y", "true"], ["no", "n", "false"]


def text(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit(""))


def strip(x: Column) -> Column:
    """Without white space at the ends."""
    return F.regexp_replace(text(x), f"^{SPACE}+|{SPACE}+$", "")


def squash(x: Column) -> Column:
    """Words joined by single spaces."""
    return strip(F.regexp_replace(text(x), f"{SPACE}+", " "))


def words(x: Column) -> Column:
    """The words between white space; none for an empty text."""
    return F.filter(F.split(squash(x), " "), lambda w: w != "")


def normalize_answer(x: Column) -> Column:
    """Lower case, single spaces, edge marks stripped once, yes and no in one spelling."""
    y = F.btrim(squash(F.lower(text(x))), F.lit(EDGE))
    return F.when(y.isin(YES), "yes").when(y.isin(NO), "no").otherwise(y)


def first_non_empty_line(x: Column) -> Column:
    """The first line with text after the first ``answer:`` anywhere, stripped; '' if there is none."""
    after = F.regexp_replace(strip(x), r"(?is)^.*?answer:", "")
    lines = F.filter(F.transform(F.split(after, r"\R"), strip), lambda v: v != "")
    return F.coalesce(F.get(lines, 0), F.lit(""))


def short_answer(x: Column, prefix: str = "Answer:") -> Column:
    """Normalized first line with text, after the first occurrence of prefix, whatever its case, if there is one."""
    return normalize_answer(first_non_empty_line(F.regexp_replace(text(x), r"(?is)^.*?\Q" + prefix + r"\E", "")))


def first_line(x: Column) -> Column:
    return F.coalesce(F.get(F.split(strip(x), r"\R"), 0), F.lit(""))


def yes_no(x: Column) -> Column:
    """'yes', 'no' or null."""
    n = normalize_answer(x)
    return F.when(n.isin("yes", "no"), n)


def title_yes_no(x: Column) -> Column:
    """'Yes' and 'No' for answers that mean them, other texts stripped."""
    n = normalize_answer(x)
    return F.when(n == "yes", "Yes").when(n == "no", "No").otherwise(strip(x))


def multiset_overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays."""
    count = lambda arr, v: F.size(F.filter(arr, lambda y: y == v))
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda n, v: n + F.least(count(a, v), count(b, v)))


def token_f1(pred: Column, gold: Column) -> Column:
    """Harmonic mean of token precision and recall of normalized texts; 0 if either has no token."""
    p, g = words(normalize_answer(pred)), words(normalize_answer(gold))
    common = multiset_overlap(p, g)
    return F.when((F.size(p) == 0) | (F.size(g) == 0) | (common == 0), F.lit(0.0)).otherwise(F.lit(2.0) * common / (F.size(p) + F.size(g)))


def strip_answer_prefix(x: Column) -> Column:
    return strip(F.regexp_replace(first_non_empty_line(x), r"(?i)^answer:", ""))


def is_image_index(x: Column) -> Column:
    return F.lower(strip(x)).rlike(rf"^image{SPACE}*[0-9]+$")


def truncate(x: Column, limit: int = 400) -> Column:
    t = text(x)
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit - 3), F.lit("..."))).otherwise(t)


def csv_list(x: Column) -> Column:
    """Items of a comma-separated list, stripped, without empty ones."""
    return F.filter(F.transform(F.split(text(x), ","), strip), lambda v: v != "")


def max_new_tokens(content_type: Column) -> Column:
    return F.when(content_type == "Abnormality", 48).otherwise(16)


def key_value_table(keys: Column, values: Column) -> Column:
    """Lines 'key : value' with keys padded to the longest of an array."""
    width = F.array_max(F.transform(keys, F.length))
    return F.array_join(F.zip_with(keys, values, lambda k, v: F.concat(F.rpad(k, width, " "), F.lit(" : "), v)), "\n")


def model_name(path: Column) -> Column:
    """Last part of a path; a checkpoint folder is named with its parent."""
    parts = F.filter(F.split(F.btrim(text(path), F.lit("/")), "/"), lambda p: p != "")
    last = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))
    return F.when(F.startswith(last, F.lit("checkpoint-")) & (F.size(parts) > 1), F.concat_ws("_", F.try_element_at(parts, F.lit(-2)), last)).otherwise(last)


def stop_reason(generated: Column, stop: Column, hit_eos: Column) -> Column:
    """stop_string, else eos, else max_new_tokens."""
    return F.when((stop != "") & F.contains(generated, stop), "stop_string").when(hit_eos, "eos").otherwise("max_new_tokens")


def judge_scores(x: Column) -> Column:
    """array(score1, score2) of a first line that has exactly two numbers, else null."""
    parts = F.split(F.get(F.split(text(x), "\n"), 0), " ")
    nums = F.transform(parts, lambda p: F.when(p.rlike(r"^[0-9]+(\.[0-9]+)?$"), p).cast("double"))
    return F.when((F.size(parts) == 2) & ~F.exists(nums, lambda v: v.isNull()), nums)


def error_matches(message: Column, tokens: list[str]) -> Column:
    """True if a message holds any of the tokens, whatever the case."""
    m = F.lower(text(message))
    got = F.lit(False)
    for t in tokens:
        got = got | F.contains(m, F.lit(t.lower()))
    return got


def name_matches(name: Column, spec: str) -> Column:
    """Module names that a target spec selects: 're:' or a text with regex marks by search, else by equality or suffix of any item."""
    from tessella.functions.driver import parse_target_spec

    kind, items = parse_target_spec(spec)
    if kind == "regex":
        return name.rlike(items[0])
    got = F.lit(False)
    for i in items:
        got = got | (name == i) | F.endswith(name, F.lit(i))
    return got


def template_name(model: Column, vision_mark: str) -> Column:
    """Conversation template that a model's name asks for; names that hold vision_mark are vision models."""
    m = F.lower(text(model))
    has = lambda part: F.contains(m, F.lit(part))
    tagged = has("mmtag") | (has("plain") & ~has("finetune"))
    vision = F.when(has("llama-2"), "vision_llama_2").when(has("v1"), F.when(tagged, "v1_mmtag").otherwise("vision_v1")).when(has("mpt"), "mpt").otherwise(F.when(tagged, "v0_mmtag").otherwise("vision_v0"))
    return F.when(has(vision_mark.lower()), vision).when(has("mpt"), "mpt").when(has("llama-2"), "llama_2").otherwise("vicuna_v1")


def thousands(x: Column) -> Column:
    return F.format_number(x, 0)


def answer_id() -> Column:
    """A random id of an answer; not the same in another run."""
    return F.uuid()

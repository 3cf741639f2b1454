"""Column expressions for text, identifiers and dates. All stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stop words of the research tokenizer.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "our", "that", "the", "this", "to", "using", "we", "with")
# The ideographs that are read character by character, and full-width forms with what they stand for.
HAN = "\u3400-\u9fff"
WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "\u3000"
NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "
TOKEN = f"[a-z0-9][a-z0-9_+#.\\-]*|[{HAN}]+"
MISSING = ("", "n/a", "na", "null", "none", "-")


def normalize_space(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def fold(c: Column) -> Column:
    """Lower case, full-width forms narrow, sharp s doubled, "&" as "and"."""
    return F.replace(F.replace(F.lower(F.translate(c, WIDE, NARROW)), F.lit("ß"), F.lit("ss")), F.lit("&"), F.lit(" and "))


def normalize_name(c: Column) -> Column:
    """Folded, everything but letters, digits and underscores of any script as one blank."""
    return F.trim(F.regexp_replace(fold(c), r"[^\p{L}\p{N}_]+", " "))


def normalize_search(c: Column) -> Column:
    """As :func:`normalize_name`, but plus, hash and full stop stay ("c++", "c#", ".net")."""
    return F.trim(F.regexp_replace(fold(c), r"[^\p{L}\p{N}_+#.]+", " "))


def normalize_letters(c: Column) -> Column:
    """Folded; only letters, marks and digits of any script stay."""
    return F.trim(F.regexp_replace(fold(c), r"[^\p{L}\p{M}\p{N}]+", " "))


def known(c: Column) -> Column:
    """The value, or null where it spells a missing one."""
    return F.when(~F.lower(F.trim(c)).isin(*MISSING), F.trim(c))


def _han(v: Column, width: int) -> Column:
    """Runs of ``width`` characters of a text, in order."""
    n = F.length(v) - (width - 1)
    return F.when(n >= 1, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substr(v, i, F.lit(width)))).otherwise(F.array().cast("array<string>"))


def tokens(c: Column) -> Column:
    """Words without stop words; a run of ideographs gives its characters, then its neighbouring pairs."""
    runs = F.regexp_extract_all(fold(F.coalesce(c, F.lit(""))), F.lit(TOKEN), F.lit(0))
    parts = F.transform(runs, lambda v: F.when(v.rlike(f"^[{HAN}]"), F.concat(_han(v, 1), _han(v, 2))).otherwise(F.array(F.regexp_replace(v, "[.-]+$", ""))))
    return F.filter(F.flatten(parts), lambda t: (t != "") & ~t.isin(*STOP_WORDS))


def counted_tokens(c: Column) -> Column:
    """Words of the online index: Latin ones from two characters on without stop words; of a run of ideographs its pairs, and itself at 3 to 10."""
    folded = F.lower(F.translate(F.coalesce(c, F.lit("")), WIDE, NARROW))
    latin = F.filter(F.regexp_extract_all(folded, F.lit("[a-z0-9][a-z0-9+#.]*"), F.lit(0)), lambda t: (F.length(t) >= 2) & ~t.isin(*STOP_WORDS))
    han = F.regexp_extract_all(folded, F.lit(f"[{HAN}]+"), F.lit(0))
    whole = F.filter(han, lambda t: F.length(t).between(3, 10))
    return F.concat(latin, whole, F.flatten(F.transform(han, lambda v: _han(v, 2))))


def signal_terms(c: Column) -> Column:
    """Distinct runs of 3 to 8 ideographs of a text."""
    han = F.regexp_extract_all(F.translate(F.coalesce(c, F.lit("")), WIDE, NARROW), F.lit(f"[{HAN}]{{3,}}"), F.lit(0))
    return F.array_distinct(F.flatten(F.transform(han, lambda v: F.concat(*[_han(v, n) for n in range(3, 9)]))))


def markup_text(c: Column) -> Column:
    """Text of JATS or HTML: no tags, the five named entities resolved, one blank between words, no leading "Abstract:"."""
    t = F.regexp_replace(c, "<[^>]+>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return F.regexp_replace(normalize_space(t), r"(?i)^abstract\s*[:.]?\s+", "")


def issn_spellings(c: Column) -> Column:
    """Distinct ISSNs found in free text, as NNNN-NNNX."""
    raw = F.regexp_extract_all(F.upper(F.coalesce(c, F.lit(""))), F.lit(r"[0-9]{4}[-\u2010-\u2015 ]?[0-9]{3}[0-9X]"), F.lit(0))
    return F.array_distinct(F.transform(raw, lambda x: F.concat(F.substr(x, F.lit(1), F.lit(4)), F.lit("-"), F.right(x, F.lit(4)))))


def lookup_key(c: Column) -> Column:
    """Normal form of a lookup: an ISSN without any dash, else the normalised name."""
    bare = F.regexp_replace(F.upper(F.trim(c)), r"[-\u2010-\u2015\s]", "")
    return F.when(bare.rlike("^[0-9]{7}[0-9X]$"), bare).otherwise(normalize_name(c))


def article_intents(c: Column) -> tuple[Column, Column]:
    """(original research, review article): what an author asks for, negated mentions removed first."""
    t = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(not|no|without|rather than|instead of)\s+(a |an |any )?(review|survey|overview|original research)s?", " ")
    t = F.regexp_replace(t, "(不是|并非|非)(综述|原创研究|原创论文)", " ")
    original = t.rlike(r"\b(original research|original article|research article|empirical study)\b|原创研究|原创论文|研究论文")
    review = t.rlike(r"\b(review article|literature review|systematic review|survey paper|meta-analysis|overview)\b|综述|元分析")
    return original, review


def first_rule(c: Column, rules: list[tuple[str, str]], other: str = "other") -> Column:
    """Label of the first rule (label, pattern) whose pattern stands in the text."""
    out = F.lit(other)
    for label, pattern in reversed(rules):
        out = F.when(F.lower(c).rlike(pattern), label).otherwise(out)
    return out


def matched_rules(c: Column, rules: list[tuple[str, str]]) -> Column:
    """Labels of all rules whose pattern stands in the text, in order of the rules."""
    return F.array_compact(F.array(*[F.when(F.lower(c).rlike(pattern), F.lit(label)) for label, pattern in rules]))


def covered_share(c: Column, terms: list[str]) -> Column:
    """Share of a text's characters that stand in at least one occurrence of a term; overlaps count once."""
    compact = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", "")
    own = [t for t in (x.lower().replace(" ", "") for x in terms) if t]
    hit = F.lit(False)
    places = F.sequence(F.lit(1), F.greatest(F.length(compact), F.lit(1)))

    def inside(i: Column) -> Column:
        held = hit
        for t in own:
            for k in range(len(t)):
                held = held | ((i > k) & (F.substr(compact, i - k, F.lit(len(t))) == t))
        return held

    return F.when(F.length(compact) > 0, F.size(F.filter(places, inside)) / F.length(compact)).otherwise(0.0)


def host_ends_with(c: Column, domains: list[str]) -> Column:
    """Whether the host of a URL is one of the domains or below one."""
    host = url_host(c)
    held = F.lit(False)
    for d in domains:
        held = held | (host == d) | host.endswith("." + d)
    return F.coalesce(held, F.lit(False))


def normalize_doi(c: Column) -> Column:
    """Lower case, without resolver or label, and without punctuation at the end."""
    bare = F.regexp_replace(F.lower(F.trim(c)), r"^(https?://[^/]+/|doi\s*:?\s*)", "")
    return F.regexp_replace(bare, r"[.,;)\s]+$", "")


def version_token(c: Column) -> Column:
    """The root of a DOI: normalised, without a version suffix; null unless it looks like one."""
    root = F.regexp_replace(normalize_doi(c), r"\.?v[0-9]+$", "")
    return F.when(root.rlike("^10[.][0-9]+/.+"), root)


def compact_issn(c: Column) -> Column:
    """The eight characters of an ISSN in upper case; null if it has another form."""
    bare = F.upper(F.regexp_replace(c, "[^0-9Xx]", ""))
    return F.when(bare.rlike("^[0-9]{7}[0-9X]$"), bare)


def valid_issn(c: Column) -> Column:
    """Whether format and check digit hold."""
    bare = compact_issn(c)
    weighted = sum((F.substring(bare, i, 1).cast("int") * (9 - i) for i in range(1, 8)), F.lit(0))
    check = F.pmod(F.lit(11) - weighted % 11, F.lit(11))
    return F.coalesce(F.when(check == 10, F.lit("X")).otherwise(check.cast("string")) == F.substring(bare, 8, 1), F.lit(False))


def distinctive_title(c: Column) -> Column:
    """At least 24 characters and four words."""
    n = normalize_name(c)
    return F.coalesce((F.length(n) >= 24) & (F.size(F.split(n, " ")) >= 4), F.lit(False))


def shingles(words: Column, width: int) -> Column:
    """Distinct runs of ``width`` words."""
    count = F.size(words) - (width - 1)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.array_join(F.slice(words, i, width), " "))
    return F.when(count >= 1, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def shingle_similarity(a: Column, b: Column) -> Column:
    """The larger of Jaccard similarity and containment."""
    common = F.size(F.array_intersect(a, b))
    union = F.size(F.array_union(a, b))
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.greatest(common / union, common / least)).otherwise(F.lit(0.0))


def url_host(c: Column) -> Column:
    """Host of an http(s) URL without credentials and port, else null."""
    host = F.regexp_extract(F.lower(c), r"^https?://([^/@?#:]+)(:[0-9]+)?([/?#]|$)", 1)
    return F.when(host != "", host)


def redact(c: Column) -> Column:
    """Values of keys, tokens and passwords replaced."""
    return F.regexp_replace(c, r"(?i)(api[_-]?key|token|password|secret)(\s*[=:]\s*)([^\s&,;]+)", "$1$2[redacted]")


def date_precision(c: Column) -> Column:
    """day, month or year of a partial ISO date; null if it is none."""
    t = F.regexp_replace(F.trim(c), "/", "-")
    return F.when(t.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.lit("day")).when(t.rlike("^[0-9]{4}-[0-9]{2}$"), F.lit("month")).when(t.rlike("^[0-9]{4}$"), F.lit("year"))


def boundary_match(text: Column, word: str) -> Column:
    """Whether ``word`` stands in the text between token boundaries."""
    escaped = "".join(f"\\{ch}" if ch in r".+*?()[]{}|^$\\" else ch for ch in word.lower())
    return F.lower(text).rlike(f"(^|[^a-z0-9_+#.]){escaped}([^a-z0-9_+#.]|$)")


def language_signal(c: Column) -> Column:
    """zh, en, mixed or other, by shares of CJK and Latin letters (.08 of the letters counts)."""
    han = F.length(F.regexp_replace(c, "[^一-鿿]", ""))
    latin = F.length(F.regexp_replace(c, "[^A-Za-z]", ""))
    total = han + latin
    return F.when(total == 0, "other").when((han >= 0.08 * total) & (latin >= 0.08 * total), "mixed").when(han >= 0.08 * total, "zh").otherwise("en")


def link_score(url: Column, label: Column) -> Column:
    """Evidence that a link leads to aims and scope: keywords 4 each, the pair 8 more, path 1, poor domains -10."""
    text = F.lower(F.concat_ws(" ", url, label))
    score = F.lit(0)
    for word in ("aims", "scope", "about", "author"):
        score = score + F.when(text.contains(word), 4).otherwise(0)
    score = score + F.when(text.contains("aims") & text.contains("scope"), 8).otherwise(0)
    score = score + F.when(F.lower(url).contains("journal"), 1).otherwise(0)
    return score + F.when(text.rlike("login|cart|cookie|twitter|facebook"), -10).otherwise(0)

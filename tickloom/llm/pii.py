"""Personal data by weak supervision, in DataFrame and SQL functions only.

Regular expressions propose candidates: strict patterns, whose valid matches are always reported, and looser ones. Labelers (the
pattern and its checks, a gazetteer, cue words before the span, its edges, its shape) vote on each candidate or abstain.
Expectation-maximisation over vote patterns - a few hundred at most, counted over all candidates - estimates the labelers' reliability; its
posteriors are the soft labels on which a naive-Bayes span classifier over kind, source, length and neighbouring characters is trained. The classifier decides
on the looser candidates.

Patterns are written so that Java's matcher neither recurses nor rescans: possessive quantifiers, and a start that is the edge of
a run or the end of the last match. They match what the plain forms match.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tickloom.llm.common import cut
from tickloom.llm.labelmodel import Belief, fit

KINDS = ("email", "ip", "card", "phone")
#: Of pattern, gazetteer, cue words, edges and shape: cue words against a span are seldom wrong, edges say little about what is no personal data.
BELIEF = Belief(prior=0.5, right_on_good=(0.95, 0.85, 0.95, 0.95, 0.9), right_on_bad=(0.9, 0.5, 0.9, 0.3, 0.5), learn_prior=False)
THRESHOLD = 0.5
_CONTEXT = 32

_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_STRICT = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9]){15,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]{1,63}+(?: ?[\[(](?:dot|DOT)[\])] ?[A-Za-z0-9-]{1,63}+)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9] ?)(?<![0-9]-)3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}(?![ -]?[0-9])",
    "phone": r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
}
#: A text without this has no match of the pattern.
_NEEDS = {
    "email": (r"contains(text, '@')", r"text rlike '(?i)[\\[(]at[\\])]'"),
    "ip": (r"text rlike '[0-9]\\.[0-9]++\\.[0-9]'", r"text rlike '[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]'"),
    "card": (r"text rlike '[0-9](?:[ -]?[0-9]){15}'", r"text rlike '3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}'"),
    "phone": (r"contains(text, '+')", r"text rlike '[0-9]{3}[ .-][0-9]{4}'"),
}
_DIGITS = "regexp_replace(m.text, '[^0-9]', '')"
_LUHN = (
    f"aggregate(sequence(1, length({_DIGITS})), 0, (s, i) -> s + (case when i % 2 = 1 then cast(substr({_DIGITS}, -i, 1) as int)"
    f" when cast(substr({_DIGITS}, -i, 1) as int) > 4 then 2 * cast(substr({_DIGITS}, -i, 1) as int) - 9 else 2 * cast(substr({_DIGITS}, -i, 1) as int) end)) % 10 = 0"
)
_VALID = {
    "email": "true",
    "ip": f"m.text rlike '^{_BYTE}(?:\\\\.{_BYTE}){{3}}$'",
    "card": f"length({_DIGITS}) between 16 and 19 and {_LUHN}",
    "phone": f"length({_DIGITS}) between 8 and 15",
}
#: Gazetteers: endings of addresses, special networks, issuers' prefixes and country codes. Fixed values.
_GAZETTEER = {
    "email": "case when lower(m.text) rlike '(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu|it|nl|ch|at)$' then '1' else '0' end",
    "ip": "case when m.text rlike '^(?:0|127|255)\\\\.' then '0' else '1' end",
    "card": f"case when {_DIGITS} rlike '^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)' then '1' else '0' end",
    "phone": "case when m.text rlike '^\\\\+(?:1|7|20|27|3[0-9]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])[^0-9]' then '1' when m.text like '+%' then '2' else '2' end",
}
#: Cue words before a span that speak for it, and those that speak against any. Fixed values.
_CUES = {
    "email": "mail|contact|write to|courriel|correo|schreib",
    "ip": "\\\\bip\\\\b|host|server|address|adresse|serveur",
    "card": "card|visa|master|amex|credit|payment|carte|tarjeta|karte",
    "phone": "tel|phone|call|fax|mobile|appel|llam|anruf",
}
_AGAINST = "version|isbn|issn|order|invoice|serial|build|\\\\bref\\\\b|\\\\bv\\\\.?$"
_SHAPE = {
    "email": "case when length(m.text) <= 80 and not contains(m.text, '..') then '1' else '0' end",
    "ip": f"case when m.text rlike '(?:^|\\\\.)0[0-9]' or not (m.text rlike '^{_BYTE}(?:\\\\.{_BYTE}){{3}}$' or contains(m.text, ':')) then '0' else '1' end",
    "card": f"case when {_LUHN} then '1' else '0' end",
    "phone": f"case when length({_DIGITS}) between 10 and 13 then '1' else '0' end",
}
_LABELERS = 5
#: Matches of a text that are gathered at once.
_MATCHES = 256
_SPAN = "array<struct<start:int,end:int,text:string,before:string,after:string>>"
_CANDIDATE = "array<struct<start:int,end:int,base:boolean,votes:string,features:array<string>>>"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _bound(value: str, name: str, body: str) -> str:
    """SQL for body with name standing for value, which is evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _matches(pattern: str) -> str:
    """SQL for the matches of a pattern in text, in order: code point ranges, what they hold, and what stands around them as far as their neighbours.

    Matches are gathered in blocks, and blocks in turn, and look around only in the gaps between them, so a text of very many matches is neither copied nor
    walked through for each.
    """
    hits, gaps = f"regexp_extract_all(text, {_quoted(pattern)}, 0)", f"split(text, {_quoted(pattern)}, -1)"
    around = f"zip_with(gaps, slice(gaps, 2, size(gaps)), (g, n) -> struct(length(g) as g, substring(g, -{_CONTEXT}) as before, substring(n, 1, 1) as after))"
    zipped = f"filter(zip_with({_bound(gaps, 'gaps', around)}, {hits}, (g, h) -> struct(g.g as g, g.before as before, g.after as after, h as h)), x -> x.h is not null)"
    span = "struct(s.at + x.g as start, s.at + x.g + length(x.h) as end, x.h as text, x.before as before, x.after as after)"
    inner = (
        f"aggregate(block, cast(struct(a.at, array()) as struct<at:int,found:{_SPAN}>),"
        f" (s, x) -> struct(s.at + x.g + length(x.h) as at, concat(s.found, array({span})) as found))"
    )
    added = _bound(inner, "r", "struct(r.at as at, concat(a.found, array(r.found)) as found)")
    blocks = f"transform(sequence(0, (size(z) - 1) div {_MATCHES}), b -> slice(z, b * {_MATCHES} + 1, {_MATCHES}))"
    folded = f"aggregate({blocks}, cast(struct(0, array()) as struct<at:int,found:array<{_SPAN}>>), (a, block) -> {added}, a -> flatten(a.found))"
    return _bound(zipped, "z", f"if(size(z) = 0, cast(array() as {_SPAN}), {folded})")


def _candidates(kind: str) -> str:
    """SQL that turns the arrays strict_KIND and loose_KIND into candidates, strict ones first."""
    before, left, right = "lower(m.before)", "substring(m.before, -1)", "m.after"
    sort = lambda c: f"case when {c} = '' then 'edge' when {c} rlike '^[0-9]$' then 'digit' when {c} rlike '^\\\\p{{L}}$' then 'letter' when {c} rlike '^\\\\s$' then 'space' else 'mark' end"
    context = f"case when {before} rlike '{_AGAINST}' then '0' when {before} rlike '{_CUES[kind]}' then '1' else '2' end"
    edges = f"case when {left} rlike '^[\\\\p{{L}}0-9]$' or {right} rlike '^[\\\\p{{L}}0-9]$' then '0' else '1' end"

    def struct(source: str, base: str, regex: str) -> str:
        votes = f"concat({regex}, {_GAZETTEER[kind]}, {context}, {edges}, {_SHAPE[kind]})"
        features = f"array(concat('source=', '{source}'), concat('length=', cast(least(length(m.text) div 4, 12) as string)), concat('left=', {sort(left)}), concat('right=', {sort(right)}))"
        return f"m -> struct(m.start as start, m.end as end, {base} as base, {votes} as votes, {features} as features)"

    strict = f"transform(strict_{kind}, {struct('strict', _VALID[kind], f"if({_VALID[kind]}, '1', '0')")})"
    # A looser match may lie in a strict one that proved invalid, not in a valid one.
    taken = [f"exists(strict_{k}, v -> v.start < m.end and m.start < v.end and {_VALID[k].replace('m.text', 'v.text')})" for k in KINDS]
    apart = f"filter(loose_{kind}, m -> not ({' or '.join(taken)}))"
    return f"concat({strict}, transform({apart}, {struct('loose', 'false', "'2'")}))"


def candidates(docs: DataFrame) -> DataFrame:
    """docs (with a string column text, which may be null) with an array of candidates for each kind, c_KIND."""
    none, out = f"cast(array() as {_SPAN})", docs
    for source, patterns in (("strict", _STRICT), ("loose", _LOOSE)):
        which = source == "loose"
        out = out.withColumns({f"{source}_{k}": F.expr(f"case when {_NEEDS[k][which]} then {_matches(patterns[k])} else {none} end") for k in KINDS})
    any_found = " or ".join(f"size({s}_{k}) > 0" for s in ("strict", "loose") for k in KINDS)
    out = out.withColumns({f"c_{k}": F.expr(f"case when {any_found} then {_candidates(k)} else cast(array() as {_CANDIDATE}) end") for k in KINDS})
    return out.drop(*[f"{s}_{k}" for s in ("strict", "loose") for k in KINDS])


def _literal_map(values: dict[str, float], key: str, default: float) -> str:
    """SQL that looks a string up in constants."""
    if not values:
        return f"double({default!r})"
    pairs = ", ".join(f"'{k}', double({v!r})" for k, v in sorted(values.items()))
    return f"coalesce(try_element_at(map({pairs}), {key}), double({default!r}))"


def train(found: DataFrame) -> dict[str, str]:
    """By kind, SQL for a candidate x's probability. found: rows with c_KIND. Two jobs; both collect a bounded number of counts."""
    spans = found.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"c_{k}").alias("c")) for k in KINDS])).alias("k")).select("k.kind", F.explode("k.c").alias("x"))
    seen: dict[str, list[tuple[str, int]]] = {k: [] for k in KINDS}
    for r in spans.groupBy("kind", F.col("x.votes").alias("votes")).agg(F.count("*").alias("n")).collect():
        seen[r["kind"]].append((r["votes"], r["n"]))
    posterior: dict[str, dict[str, float]] = {}
    for kind, patterns in seen.items():
        votes = np.array([list(map(int, v)) for v, _ in patterns], np.int64).reshape(-1, _LABELERS)
        model = fit(votes, np.array([n for _, n in patterns], np.float64), BELIEF)
        posterior[kind] = {v: float(p) for (v, _), p in zip(patterns, model.posterior(votes), strict=True)}
    soft = F.coalesce(*[F.when(F.col("kind") == k, F.expr(_literal_map(posterior[k], "x.votes", 0.5))) for k in KINDS])
    labelled = spans.select("kind", soft.alias("p"), F.explode(F.concat(F.array(F.lit("all")), "x.features")).alias("feature"))
    sums = {(r["kind"], r["feature"]): (r["p"], r["n"]) for r in labelled.groupBy("kind", "feature").agg(F.sum("p").alias("p"), F.count("*").alias("n")).collect()}
    scores = {}
    for kind in KINDS:
        yes, n = sums.get((kind, "all"), (0.0, 0))
        odds = {f: math.log((p + 1) / (yes + 12)) - math.log((c - p + 1) / (n - yes + 12)) for (k, f), (p, c) in sums.items() if k == kind and f != "all"}
        # Votes count through the label model, the rest of the span through the features.
        logit = {v: math.log(p / (1 - p)) for v, p in ((v, min(max(p, 1e-9), 1 - 1e-9)) for v, p in posterior[kind].items())}
        scores[kind] = f"1 / (1 + exp(-({_literal_map(logit, 'x.votes', 0.0)} + aggregate(x.features, double(0), (s, f) -> s + {_literal_map(odds, 'f', 0.0)}))))"
    return scores


def accepted(kind: str, scores: dict[str, str], threshold: float) -> Column:
    """The reported spans of a kind, by start: all valid strict matches, and looser candidates that the classifier believes."""
    return F.expr(f"array_sort(transform(filter(c_{kind}, x -> x.base or (x.features[0] = 'source=loose' and {scores[kind]} >= {threshold})), x -> struct(x.start as start, x.end as end, x.base as base)))")


def find(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and, for each kind, an array of its spans (start, end exclusive, base), in code points, for each row of docs.

    Null and empty texts have none; repeated rows get the same spans, null ids stay null; an empty table gives no rows; other columns are not read. Texts of any
    length are read whole, and once: the candidates, without the text, are written and serve training and the result.
    """
    found = cut(candidates(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))).drop("text"))
    scores = train(found)
    return found.select("doc_id", *[accepted(k, scores, threshold).alias(k) for k in KINDS])


def digest(spans: DataFrame) -> DataFrame:
    listed = lambda only: F.array_join(F.concat(*[F.expr(f"transform(filter({k}, x -> {only}), x -> concat('{k}:', x.start, ':', x.end))") for k in KINDS]), ",")
    count = lambda k: F.expr(f"cast(size(filter({k}, x -> x.base)) as bigint)").alias(f"n_{k}")
    return spans.select("doc_id", *[count(k) for k in KINDS], F.sha2(listed("x.base").cast("binary"), 256).alias("base_sha256"), listed("true").alias("spans"))


def redact(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with every span replaced by its kind in angle brackets; of overlapping spans the first, and of those that start together the longest, covers.

    All columns and rows stay, repeated rows and null ids too; null texts stay null, an empty table empty; a whole number n_chars, if there is one, follows a text that changes. Texts are
    read twice, for training and for the result, so that they are neither written nor shuffled between.
    """
    names, held = docs.columns, [f"_c{i}" for i in range(len(docs.columns))]
    at = names.index("text")
    keyed = docs.toDF(*held).withColumn("text", F.col(held[at]).cast("string"))
    scores = train(cut(candidates(keyed.select("text")).drop("text")))
    spans = candidates(keyed).withColumns({f"s_{k}": accepted(k, scores, threshold) for k in KINDS})
    tagged = ", ".join(f"transform(s_{k}, x -> struct(x.start as a, -x.end as b, '<{k}>' as tag))" for k in KINDS)
    fold = (
        f"aggregate(array_sort(concat({tagged})), cast(struct(0, '') as struct<at:int,out:string>), (s, x) -> if(x.a < s.at,"
        " struct(greatest(s.at, -x.b) as at, s.out as out), struct(-x.b as at, concat(s.out, substring(text, s.at + 1, x.a - s.at), x.tag) as out)),"
        " s -> concat(s.out, substring(text, s.at + 1, length(text))))"
    )
    some = " or ".join(f"size(s_{k}) > 0" for k in KINDS)
    done = spans.withColumn("text", F.expr(f"case when {some} then {fold} else text end"))
    out = [F.col("text").alias(n) if i == at else F.col(c).alias(n) for i, (c, n) in enumerate(zip(held, names, strict=True))]
    if "n_chars" in names and isinstance(docs.schema["n_chars"].dataType, IntegralType):
        k = names.index("n_chars")
        changed = F.col("text") != F.col(held[at]).cast("string")
        out[k] = F.when(changed, F.char_length("text")).otherwise(F.col(held[k])).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return done.select(*out)

"""PII detection and masking over document columns.

All work is JVM-side Spark expressions: one regex pass per rule produces a
``parts`` array that alternates unmatched text and matches
(``[s0, m1, s1, m2, ..., sn]``). Counts, masked text, matched strings and
code-point spans are all read from that array, so a rule's regex runs once
per document however many outputs are requested.

Two semantics, as in the reference:

* ``mask`` (sequential): rules run in order, each on the text already masked
  by the earlier rules; spans refer to the text at that stage.
* ``detect`` (audit): every rule runs on the original text independently;
  spans refer to the original text and carry a +-30 character context.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimflow.functions.arrays import exclusive_prefix_sums, interleave, let
from claimflow.functions.pii_rules import DEFAULT_REGISTRY, PiiRegistry, PiiRule, may_match

_SEP = "\ue000"  # private-use code point marking match boundaries
CONTEXT_CHARS = 30


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def match_parts(text: Column, rule: PiiRule) -> Column:
    """``array<string>`` of alternating unmatched / matched segments.

    Fast path: one ``regexp_replace`` wraps each match in a private-use
    separator, then a literal ``split``. Texts that already contain the
    separator take the exact two-pass path (``split`` on the pattern plus
    ``regexp_extract_all``), so no input can corrupt the segmentation.
    """
    p = rule.java_pattern
    fast = F.split(F.regexp_replace(text, p, _SEP + "$0" + _SEP), _SEP, -1)
    gaps = F.split(text, p, -1)
    hits = F.regexp_extract_all(text, F.lit(p), F.lit(0))
    slow = interleave(gaps, hits)
    parts = F.when(F.instr(text, _SEP) == 0, fast).otherwise(slow)
    guard = may_match(rule, text)
    return parts if guard is None else F.when(guard, parts).otherwise(F.array(text))


def _n_matches(parts: Column) -> Column:
    return ((F.size(parts) - 1) / 2).cast("int")


def _replace_matches(parts: Column, replacement: str) -> Column:
    joined = F.array_join(
        F.transform(parts, lambda v, i: F.when(i % 2 == 1, F.lit(replacement)).otherwise(v)), "")
    # Most rules match nothing in most documents: skip the array work then.
    return F.when(F.size(parts) == 1, parts[0]).otherwise(joined)


_MATCH_TYPE = "array<struct<m:string,start:bigint>>"


def _matches_with_starts(parts: Column) -> Column:
    """``array<struct<m string, start bigint>>`` of the matches and their
    0-based code-point offsets in the text the parts came from."""
    def paired(p: Column) -> Column:
        starts = exclusive_prefix_sums(F.transform(p, lambda v: F.length(v)))
        both = F.zip_with(p, starts, lambda v, st: F.struct(v.alias("m"), st.alias("start")))
        return F.filter(both, lambda z, i: i % 2 == 1)

    # Most rules match nothing in most documents: skip the array work then.
    return F.when(F.size(parts) == 1, F.array().cast(_MATCH_TYPE)).otherwise(let(parts, paired))


def _by_type(rules: Sequence[PiiRule], counts: Sequence[Column]) -> Column:
    """``map<string,int>`` of per-type totals, types with no hit dropped, keys in
    first-detection order (a type repeated in the rule list accumulates)."""
    order: dict[str, list[int]] = {}
    for idx, r in enumerate(rules):
        order.setdefault(r.name, []).append(idx)
    if not order:
        return F.create_map().cast("map<string,int>")
    entries = []
    for name, idxs in order.items():
        total = sum((counts[i] for i in idxs[1:]), counts[idxs[0]])
        first = F.least(*[F.when(counts[i] > 0, F.lit(i)) for i in idxs]) if len(idxs) > 1 \
            else F.when(counts[idxs[0]] > 0, F.lit(idxs[0]))
        entries.append(F.struct(first.alias("ord"), F.lit(name).alias("key"), total.cast("int").alias("value")))
    hit = F.filter(F.array(*entries), lambda e: e["value"] > 0)
    ordered = F.array_sort(hit)  # struct ordering: by ord first
    return F.map_from_entries(F.transform(ordered, lambda e: F.struct(e["key"], e["value"])))


# --------------------------------------------------------------- sequential
def mask_text(text, types=None, registry: PiiRegistry = DEFAULT_REGISTRY) -> Column:
    """Masked text only (the quick ``filter_sensitive_data`` path): one
    ``regexp_replace`` per rule and no arrays. Each stage's text is bound
    once, and a rule's pass is skipped where its guard shows it cannot match."""
    out = _col(text)
    for rule in registry.select(types):
        out = let(out, _stage(rule))
    return out


def _stage(rule: PiiRule):
    """The text with the rule's matches replaced, as a function of the text."""
    def replace(t: Column) -> Column:
        replaced = F.regexp_replace(t, rule.java_pattern, _java_literal(rule.replacement))
        guard = may_match(rule, t)
        return replaced if guard is None else F.when(guard, replaced).otherwise(t)
    return replace


def _java_literal(s: str) -> str:
    # Java replacement strings treat '$' and '\' specially.
    return s.replace("\\", "\\\\").replace("$", "\\$")


def mask_document(df: DataFrame, text_col: str = "text", types=None,
                  registry: PiiRegistry = DEFAULT_REGISTRY, with_spans: bool = True,
                  prefix: str = "") -> DataFrame:
    """Sequential masking (``filter_document``) as added columns.

    Adds ``{prefix}filtered_text``, ``{prefix}detections``
    (``array<struct<type, description, original, replacement, stage_start,
    stage_end>>``), ``{prefix}n_<type>`` per applied type,
    ``{prefix}total_detections``, ``{prefix}by_type``,
    ``{prefix}original_length`` and ``{prefix}filtered_length``.
    """
    rules = registry.select(types)
    text = F.col(text_col)
    stage_cols, counts, det_parts = [], [], []
    cur = df
    # Each stage is its own projection so every regex runs once per row;
    # Catalyst keeps the stages apart instead of inlining them repeatedly.
    for s, rule in enumerate(rules):
        pcol, tcol = f"__parts{s}", f"__text{s}"
        cur = cur.withColumn(pcol, match_parts(text, rule))
        cur = cur.withColumn(tcol, _replace_matches(F.col(pcol), rule.replacement))
        stage_cols += [pcol, tcol]
        counts.append(_n_matches(F.col(pcol)))
        if with_spans:
            det_parts.append(_stage_detections(F.col(pcol), rule))
        text = F.col(tcol)
    total = sum(counts[1:], counts[0]) if counts else F.lit(0)
    out = cur.withColumn(prefix + "filtered_text", text)
    if with_spans:
        dets = F.concat(*det_parts) if det_parts else F.array().cast(_DET_MASK_TYPE)
        out = out.withColumn(prefix + "detections", dets)
    seen = set()
    for rule, c in zip(rules, counts):
        name = prefix + "n_" + rule.name
        if rule.name in seen:
            out = out.withColumn(name, F.col(name) + c)
        else:
            out = out.withColumn(name, c.cast("bigint"))
            seen.add(rule.name)
    out = (out.withColumn(prefix + "total_detections", total.cast("int"))
              .withColumn(prefix + "by_type", _by_type(rules, counts))
              .withColumn(prefix + "original_length", F.length(text_col))
              .withColumn(prefix + "filtered_length", F.length(prefix + "filtered_text")))
    return out.drop(*stage_cols)


_DET_MASK_TYPE = ("array<struct<type:string,description:string,original:string,"
                  "replacement:string,stage_start:bigint,stage_end:bigint>>")
_DET_AUDIT_TYPE = ("array<struct<type:string,description:string,found:string,"
                   "start:bigint,end:bigint,context:string>>")


def _stage_detections(parts: Column, rule: PiiRule) -> Column:
    return F.transform(_matches_with_starts(parts), lambda z: F.struct(
        F.lit(rule.name).alias("type"),
        F.lit(rule.description).alias("description"),
        z["m"].alias("original"),
        F.lit(rule.replacement).alias("replacement"),
        z["start"].alias("stage_start"),
        (z["start"] + F.length(z["m"])).alias("stage_end"),
    ))


# ------------------------------------------------------------------- audit
def context_snippet(text: Column, start: Column, end: Column, chars: int = CONTEXT_CHARS,
                    text_length: Column | None = None) -> Column:
    """Text within ``chars`` of a span; ``...`` marks each truncated side.
    Pass ``text_length`` when it is already known (it costs a full scan)."""
    n = F.length(text) if text_length is None else text_length
    cs = F.greatest(start - chars, F.lit(0))
    ce = F.least(end + chars, n)
    body = F.substring(text, cs + 1, ce - cs)
    return F.concat(F.when(cs > 0, F.lit("...")).otherwise(F.lit("")), body,
                    F.when(ce < n, F.lit("...")).otherwise(F.lit("")))


def detect_document(df: DataFrame, text_col: str = "text", types=None,
                    registry: PiiRegistry = DEFAULT_REGISTRY, with_spans: bool = True,
                    prefix: str = "", with_context: bool = True) -> DataFrame:
    """Detect-only audit (``detect_only``): each rule on the original text.

    Adds ``{prefix}detections`` (``array<struct<type, description, found,
    start, end, context>>``; null contexts without ``with_context``), ``{prefix}n_<type>``, ``{prefix}total_detections``,
    ``{prefix}by_type`` and ``{prefix}has_sensitive_data``.
    """
    rules = registry.select(types)
    text = F.col(text_col)
    cur = df
    counts, tmp = [], []
    for s, rule in enumerate(rules):
        pcol = f"__dparts{s}"
        cur = cur.withColumn(pcol, match_parts(text, rule))
        tmp.append(pcol)
        counts.append(_n_matches(F.col(pcol)))
    total = sum(counts[1:], counts[0]) if counts else F.lit(0)
    out = cur
    if with_spans:
        out = out.withColumn(prefix + "detections", _audit_detections(text, [F.col(c) for c in tmp], rules, with_context)
                             if rules else F.array().cast(_DET_AUDIT_TYPE))
    seen = set()
    for rule, c in zip(rules, counts):
        name = prefix + "n_" + rule.name
        out = out.withColumn(name, (F.col(name) + c) if rule.name in seen else c.cast("bigint"))
        seen.add(rule.name)
    out = (out.withColumn(prefix + "total_detections", total.cast("int"))
              .withColumn(prefix + "by_type", _by_type(rules, counts))
              .withColumn(prefix + "has_sensitive_data", total > 0))
    return out.drop(*tmp)


def _audit_detections(text: Column, parts: Sequence[Column], rules: Sequence[PiiRule], with_context: bool) -> Column:
    """The detections of all rules, in their order.

    The rules' parts become one array, so the plan holds the expression for
    spans once and not for each rule; that is most of what planning costs.
    """
    found = F.array(*[F.struct(F.lit(r.name).alias("type"), F.lit(r.description).alias("description"), p.alias("parts"))
                      for r, p in zip(rules, parts)])

    def listed(n: Column) -> Column:
        def detection(rule: Column, z: Column) -> Column:
            end = z["start"] + F.length(z["m"])
            context = context_snippet(text, z["start"], end, text_length=n) if with_context else F.lit(None).cast("string")
            return F.struct(rule["type"].alias("type"), rule["description"].alias("description"), z["m"].alias("found"),
                            z["start"].alias("start"), end.alias("end"), context.alias("context"))
        return F.flatten(F.transform(found, lambda rule: F.transform(
            _matches_with_starts(rule["parts"]), lambda z: detection(rule, z))))

    # The text's length is bound once per document, not per detection.
    return let(F.length(text), listed) if with_context else listed(F.lit(0))


# ------------------------------------------------------------ corpus level
def explode_detections(df: DataFrame, id_cols: Sequence[str], det_col: str = "detections") -> DataFrame:
    """Long table: one row per detection, with its index in the document.

    The outer generator plus an explicit null filter is deliberate: for a
    plain ``posexplode`` the optimizer infers ``size(detections) > 0`` below
    the generator and pushes it through the projections, which copies the
    whole regex chain into the filter and runs it again per reference.
    """
    return (df.select(*id_cols, F.posexplode_outer(det_col).alias("det_no", "d"))
              .where(F.col("d").isNotNull())
              .select(*id_cols, "det_no", "d.*"))


def corpus_summary(df: DataFrame, types: Sequence[str], prefix: str = "") -> DataFrame:
    """Detections per type over a corpus, from per-document counts: a single
    partial+final aggregation, no explode and no shuffle of text."""
    uniq = list(dict.fromkeys(types))
    agg = df.agg(*[F.sum(prefix + "n_" + t).alias(t) for t in uniq],
                 *[F.sum(F.when(F.col(prefix + "n_" + t) > 0, 1).otherwise(0)).alias("docs_" + t) for t in uniq])
    stacked = ", ".join(f"'{t}', {i}, `{t}`, `docs_{t}`" for i, t in enumerate(uniq, start=1))
    return agg.selectExpr(
        f"stack({len(uniq)}, {stacked}) as (type, type_ord, n_detections, n_documents)"
    ).select("type", F.col("type_ord").cast("int"),
             F.coalesce(F.col("n_detections").cast("bigint"), F.lit(0).cast("bigint")).alias("n_detections"),
             F.coalesce(F.col("n_documents").cast("bigint"), F.lit(0).cast("bigint")).alias("n_documents"))


def filter_report(df: DataFrame, prefix: str = "", out_col: str = "report") -> DataFrame:
    """Human-readable report lines per document as one text column.

    Lengths are always reported when there are detections (also for
    audit results, where the reference had none to show)."""
    total = F.col(prefix + "total_detections")
    by_type = F.col(prefix + "by_type")
    lines_by_type = F.array_join(
        F.transform(F.map_entries(by_type), lambda e: F.concat(F.lit("  - "), e["key"], F.lit(": "),
                                                                e["value"].cast("string"))), "\n")
    has_len = prefix + "original_length" in df.columns
    lengths = (F.concat(F.lit("\n\nOriginal Length: "), F.col(prefix + "original_length").cast("string"),
                        F.lit(" chars\nFiltered Length: "), F.col(prefix + "filtered_length").cast("string"),
                        F.lit(" chars")) if has_len else F.lit(""))
    head = F.concat(F.lit("Content Filtering Report\n" + "=" * 50 + "\n\nTotal Detections: "),
                    total.cast("string"))
    body = F.when(total > 0, F.concat(F.lit("\n\nDetections by Type:\n"), lines_by_type, lengths)) \
        .otherwise(F.lit("\n\nNo sensitive information detected."))
    return df.withColumn(out_col, F.concat(head, body))


def apply_filtering(df: DataFrame, enabled: bool, text_col: str = "text", **kw) -> DataFrame:
    """Masking switch: off keeps the text and reports zero detections."""
    if enabled:
        return mask_document(df, text_col, **kw)
    prefix = kw.get("prefix", "")
    return (df.withColumn(prefix + "filtered_text", F.col(text_col))
              .withColumn(prefix + "detections", F.array().cast(_DET_MASK_TYPE))
              .withColumn(prefix + "total_detections", F.lit(0))
              .withColumn(prefix + "by_type", F.create_map().cast("map<string,int>"))
              .withColumn(prefix + "original_length", F.length(text_col))
              .withColumn(prefix + "filtered_length", F.length(text_col)))

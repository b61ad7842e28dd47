"""Text for people: results, a search's stages, a catalog's state, and Markdown tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Row

from .engine import SHOWN, Engine, Report


def results(rows: Sequence[Row]) -> str:
    """Two lines a result: name with up to four attributes, then code and score."""
    lines = []
    for r in rows:
        listed = ", ".join(f"{k}: {v}" for k, v in list((r["attributes"] or {}).items())[:4])
        lines += [f"{r['final_rank']}. {r['name']}" + (f" ({listed})" if listed else ""), f"   {r['code']} — Score: {r['final_score']:.2f}"]
    return "\n".join(lines) or "No results."


def _place(rank: int | None) -> str:
    return "-" if rank is None else f"#{rank}"


def stages(text: str, rows: Sequence[Row], report: Report, engine: Engine) -> str:
    """The whole pipeline of one search: query, lists, reranker, best results, timings, degradations."""
    out = ["QUERY", f"  original:   {text}"]
    asked = report.frames["queries"].first() if "queries" in report.frames else None
    if asked is not None:
        out.append(f"  normalized: {asked['text']}")
        if "corrections" in asked and asked["corrections"]:
            out.append("  corrections: " + ", ".join(f"{c['from']} -> {c['to']} ({c['kind']})" for c in asked["corrections"]))
        if "attribute_values" in asked and asked["attribute_values"]:
            out.append("  attributes: " + ", ".join(f"{k}={v}" for k, v in asked["attribute_values"].items()))
    out += ["", "RETRIEVAL"]
    for source, name in (("bm25", "BM25"), ("vector", "Vector")):
        best = report.frames[source].orderBy("score", ascending=False).limit(SHOWN).collect() if source in report.frames else []
        out.append(f"  {name + ':':8}{len(best)}" + (f" (top: {best[0]['product_id']} {best[0]['score']:.3f})" if best else ""))
    n = report.frames["candidates"].count() if "candidates" in report.frames else 0
    out += [f"  RRF:    {n} candidates (k={engine.config['fusion.k']})", "", "RERANKER", f"  provider: {report.reranker}", "", "TOP RESULTS"]
    for r in rows[:5]:
        out.append(
            f"  {r['final_rank']}. {r['product_id']} {r['name']} [bm25: {_place(r['bm25_rank'])} | vector: {_place(r['vector_rank'])} | rrf: {r['rrf_score']:.4f}"
            f" | reranker: {r['rerank_score']:.3f} | final: {r['final_score']:.3f}]"
        )
    out += ["", "TIMINGS", *[f"  {name + ':':18}{ms} ms" for name, ms in report.timings.items()]]
    if report.degradations:
        out += ["", "DEGRADATIONS", *[f"  [{d.stage}] {d.message}" for d in report.degradations]]
    return "\n".join([*out, "", f"  search_id: {report.search_id}  index_version: {engine.version}"])


def state(facts: Mapping[str, object]) -> str:
    """`name: value` lines."""
    return "\n".join(f"{k + ':':18}{v}" for k, v in facts.items())


def markdown(rows: Iterable[Mapping[str, object]]) -> str:
    """A Markdown table: numbers with three digits, missing values as -."""
    rows = list(rows)
    if not rows:
        return ""
    shown = lambda v: "-" if v is None else f"{v:.3f}" if isinstance(v, float) else f"{v:,}" if isinstance(v, int) and not isinstance(v, bool) else str(v)
    head = list(rows[0])
    lines = ["| " + " | ".join(head) + " |", "|" + "-|" * len(head)]
    return "\n".join([*lines, *["| " + " | ".join(shown(r[c]) for c in head) + " |" for r in rows]])

"""Results for people and programs: JSON and text reports with a trace."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_json(frame: DataFrame) -> DataFrame:
    """One column, a JSON object a row."""
    return frame.select(F.to_json(F.struct(*frame.columns), {"ignoreNullFields": "false"}).alias("json"))


def write_json(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").json(path)


def trace(topic: str, a_name: str | None, links: list, n_bridges: int = 0, n_candidates: int = 0, verified: bool = False) -> list[dict]:
    """The steps of a run, in order."""
    steps = [("resolve", f"'{topic}' is '{a_name}'." if a_name else f"No concept for '{topic}'.")]
    if a_name:
        steps += [("bridges", f"{n_bridges} bridges chosen."), ("candidates", f"{n_candidates} concepts two steps away."), ("rank", f"{len(links)} links ranked."), ("hypothesize", f"{len(links)} hypotheses written.")]
        steps += [("verify", "Links held against an independent count.")] if verified else []
        steps += [("done", f"{len(links)} results.")]
    return [{"seq": i, "step": s, "detail": t, "data": {}} for i, (s, t) in enumerate(steps)]


def report(topic: str, hyps: DataFrame, verified: bool = False) -> dict:
    """A bundle of one topic's few results (max_results rows)."""
    rows = [r.asDict(recursive=True) for r in hyps.orderBy("final_rank" if "final_rank" in hyps.columns else "rank").collect()]
    first = rows[0] if rows else {}
    stats = {"bridges": first.get("n_bridges", 0), "candidates": first.get("n_candidates", 0), "results": len(rows)}
    return {"topic": topic, "source_concept": first.get("a_name"), "hypotheses": rows, "trace": trace(topic, first.get("a_name"), rows, stats["bridges"], stats["candidates"], verified), "reasoner": "fallback", "stats": stats}


def as_text(bundle: dict) -> str:
    lines = [f"Topic: {bundle['topic']}  ({bundle['source_concept'] or 'not found'})", ""]
    for i, h in enumerate(bundle["hypotheses"], 1):
        lines += [f"{i}. {h['statement']}", f"   via {', '.join(h['bridges'])}", f"   score {h['score']:.3f}  novelty {h['novelty']:.3f}  plausibility {h['plausibility']:.3f}" + (f"  {h['verdict']}" if "verdict" in h else "")]
        lines += [f"   cites {w['title'] or w['work']}" + (f" ({w['year']})" if w.get("year") else "") + (f" {w['url']}" if w.get("url") else "") for w in h.get("works_cited") or []]
        lines += [f"   {h['verification_note']}"] if h.get("verification_note") else []
        lines += [f"   evidence [{i.get('kind') or 'paper'}] {i['title']}" + (f" ({i['year']})" if i.get("year") else "") + (f" {i['url']}" if i.get("url") else "") for i in h.get("items") or []]
    return "\n".join([*lines, "", *(f"[{t['step']}] {t['detail']}" for t in bundle["trace"])])


def to_json(bundle: dict) -> str:
    return json.dumps(bundle, indent=2, ensure_ascii=False, default=str)

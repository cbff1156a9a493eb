"""Reports as aligned text. Only report rows come to the driver, which are as many as are printed."""

from __future__ import annotations

import json
import os
import shutil

from ..functions import pricing

COLUMNS = ("requests", "input", "output", "cache_create", "cache_read", "total")
_WIDTHS = (8, 12, 12, 13, 13, 14)


def thousands(n: int) -> str:
    return f"{n:,}".replace(",", " ")


def usd(x: float) -> str:
    return "$0.00" if x == 0 else f"${x:.4f}" if abs(x) < 0.01 else f"${x:.2f}"


def shortened(path: str, home: str) -> str:
    return f"~{path[len(home):]}" if home and path.startswith(home) else path


def header(title: str, width: int, cost: bool) -> str:
    names = [c.replace("_", "-") for c in COLUMNS]
    return f"{title:<{width}} " + " ".join(f"{n:>{w}}" for n, w in zip(names, _WIDTHS, strict=True)) + (f" {'API Cost':>12}" if cost else "")


def line(name: str, row, width: int, cost: bool) -> str:
    cells = " ".join(f"{thousands(row[c]):>{w}}" for c, w in zip(COLUMNS, _WIDTHS, strict=True))
    return f"{name:<{width}} {cells}" + (f" {usd(row['cost']):>12}" if cost else "")


def width_of(names, least: int = 0) -> int:
    return max([least, *(len(n.encode()) for n in names)])


def cost_lines(total) -> list[str]:
    out = ["", "API cost: an estimate of what this usage would have cost at list prices.", "It is not what a subscription charges, and is made from local transcripts.", ""]
    for name, c in zip(("input", "output", "cache write", "cache read"), pricing.PARTS, strict=True):
        share = f"{total[c] / total['cost'] * 100:>5.1f}%" if total["cost"] > 0 else "    -"
        out.append(f"  {name:<12} {usd(total[c]):>12}  {share}")
    out.append(f"  {'TOTAL':<12} {usd(total['cost']):>12}")
    if total["unpriced"]:
        out += ["", f"  note: {thousands(total['unpriced'])} tokens came from models without a price", "  and are not in the figures above."]
    return out


def coverage_lines(row) -> list[str]:
    if row is None or row["percent"] is None:
        return []
    return ["", f"Coverage: {row['percent']:.1f}% of the tokens that the host counted itself in {row['sessions']} session(s).", "The rest never reached a transcript, such as retries and aborted turns."]


def summary(rows, coverage, first: str, last: str, home: str, cost: bool) -> list[str]:
    if not rows:
        return ["No requests in range. Run backfill if the ledger is new."]
    total = next(r for r in rows if r["kind"] == "total")
    out, width = [f"{first} .. {last}   {total['requests']} requests", ""], 0
    for kind in ("model", "project"):
        some = sorted((r for r in rows if r["kind"] == kind), key=lambda r: r["name"])
        names = [shortened(r["name"], home) for r in some]
        width = width_of(names, len(kind))
        out += [header(kind, width, cost), *[line(n, r, width, cost) for n, r in zip(names, some, strict=True)], ""]
    out.append(line("TOTAL", total, width, cost))
    return out + (cost_lines(total) if cost else []) + coverage_lines(coverage)


def breakdown(rows, cost: bool, grouped: bool) -> list[str]:
    if not rows:
        return ["No requests in range."]
    total = next(r for r in rows if r["bucket"] == "TOTAL")
    rest = sorted((r for r in rows if r["bucket"] != "TOTAL"), key=lambda r: (r["bucket"], r["grp"]))
    name = lambda r: f"{r['bucket']}  {r['grp']}" if grouped else r["bucket"]
    width = width_of([name(r) for r in rest], len("TOTAL"))
    out = [header("", width, cost), *[line(name(r), r, width, cost) for r in rest], line("TOTAL", total, width, cost)]
    return out + (cost_lines(total) if cost else [])


def sessions(rows, day, home: str) -> list[str]:
    if not rows:
        return ["No sessions recorded."]
    out = [f"{'session':<38} {'tokens':>12} {'last seen':>12}  project"]
    return out + [f"{r['session_id']:<38} {thousands(r['tokens']):>12} {day(r['last_seen']):>12}  {shortened(r['project_dir'], home)}" for r in rows]


def bytes_human(n: int) -> str:
    return f"{n / 1048576:.1f} MB" if n >= 1 << 20 else f"{n // 1024} kB"


def settings(command: str) -> str:
    """The fragment of the host's settings that runs a status-line command, by its absolute path where it can be found."""
    found = shutil.which(command)
    if found:
        command = os.path.abspath(found)
    return f'"statusLine": {{"type": "command", "command": {json.dumps(command, ensure_ascii=False)}}}'

"""The status line as one string column of a decoded payload, today's totals, and a branch."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import buckets, formats

#: Colours, icons, and widths of the line.
RESET, GREY, RED, GREEN, YELLOW, CYAN = "\x1b[0m", "\x1b[90m", "\x1b[31m", "\x1b[32m", "\x1b[33m", "\x1b[36m"
ORANGE, BLUE, MAGENTA, TEAL = "\x1b[38;5;208m", "\x1b[38;5;12m", "\x1b[38;5;13m", "\x1b[38;5;14m"
ICON_BRANCH, ICON_MODEL, ICON_CONTEXT, ICON_TOKENS, ICON_LIMITS = "\U000f02a2", "\ue26d", "\uf49b", "\uf0ec", "\uf252"
BAR_WIDTH, BRANCH_MOST = 10, 32
NAME = "talliq"


def _text(*parts: Column | str) -> Column:
    """Joined parts; null if any is null."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _rounded(x: Column) -> Column:
    """A percentage as a whole number; below zero it is zero."""
    return F.when(x < 0, F.lit("0")).otherwise(F.round(x).cast("long").cast("string"))


def colour(pct: Column) -> Column:
    return F.when(pct >= 90, RED).when(pct >= 70, ORANGE).when(pct >= 50, YELLOW).otherwise(GREY)


def bar(pct: Column) -> Column:
    filled = F.least(F.greatest(F.round(pct * BAR_WIDTH / 100), F.lit(0.0)), F.lit(float(BAR_WIDTH))).cast("int")
    return F.concat(F.repeat(F.lit("█"), filled), F.repeat(F.lit("░"), BAR_WIDTH - filled))


def _context(pct: Column, short: bool) -> Column:
    held = F.when(pct < 0, F.lit(0.0)).when(pct > 100, F.lit(100.0)).otherwise(pct)
    if short:
        return _text(colour(held), _rounded(held), "%", RESET)
    return _text(f"{MAGENTA}{ICON_CONTEXT} {GREY}", bar(held), f"{RESET} ", colour(held), _rounded(held), "%", RESET)


def _limits(payload: Column, now: Column) -> Column:
    parts = []
    for name, field in (("5h", "five_hour"), ("7d", "seven_day")):
        limit = payload["rate_limits"][field]
        pct, left = limit["used_percentage"], buckets.countdown(limit["resets_at"], now)
        until = F.coalesce(_text(f"{GREY} (", left, ")"), F.lit(""))
        parts.append(_text(f"{GREY}{name} ", colour(pct), _rounded(pct), "%", until, RESET))
    some = F.coalesce(*parts)
    return F.when(some.isNotNull(), _text(f"{GREY}{ICON_LIMITS} {RESET}", F.concat_ws(" ", *parts)))


def _model(payload: Column) -> Column:
    name = F.coalesce(payload["model"]["display_name"], payload["model"]["id"])
    size = payload["context_window"]["context_window_size"]
    extra = lambda x: F.coalesce(_text(f"{GREY} · ", x, RESET), F.lit(""))
    return _text(f"{TEAL}{ICON_MODEL} {ORANGE}", formats.without_parenthesis(name), RESET, extra(formats.window_size(size)), extra(payload["effort"]["level"]))


def _today(tokens: Column, cost: Column, by_cost: bool) -> Column:
    value = _text("$", formats.short_cost(cost)) if by_cost else formats.token_count(tokens)
    return _text(f"{GREY}{ICON_TOKENS} today {RESET}", value)


def display_dir(payload: Column) -> Column:
    return F.coalesce(payload["workspace"]["current_dir"], payload["cwd"])


def project_dir(payload: Column) -> Column:
    """The folder in which the session began, or else the one that is shown."""
    return F.coalesce(payload["workspace"]["project_dir"], display_dir(payload))


def _head(payload: Column, branch: Column, home: str, short: bool) -> Column:
    folder = F.coalesce(formats.abbreviated_path(display_dir(payload), home), F.lit(""))
    bare = _text(CYAN, folder, RESET)
    if short:
        return bare
    added = F.coalesce(payload["cost"]["total_lines_added"], F.lit(0))
    removed = F.coalesce(payload["cost"]["total_lines_removed"], F.lit(0))
    changed = F.when((added == 0) & (removed == 0), F.lit("")).otherwise(_text(f"({GREEN}+", added.cast("string"), f"{RESET} {RED}-", removed.cast("string"), f"{RESET})"))
    on = _text(f"{BLUE}{ICON_BRANCH} {GREEN}", formats.middle_cut(branch, BRANCH_MOST), changed, RESET)
    with_branch = F.when(folder == "", on).otherwise(_text(bare, " ", on))
    return F.when(F.coalesce(branch, F.lit("")) == "", bare).otherwise(with_branch)


def fallback(folder: Column, home: str) -> Column:
    """What is shown without a usable payload; never empty."""
    return F.coalesce(_text(CYAN, formats.abbreviated_path(folder, home), RESET), F.lit(f"{GREY}{NAME}{RESET}"))


def line(payload: Column, tokens: Column, cost: Column, branch: Column, now: Column, *, home: str = "", short: bool = False, by_cost: bool = False) -> Column:
    """Folder and branch, context, limits, model, today; parts without data are left out. A null payload falls back."""
    context = _context(payload["context_window"]["used_percentage"], short)
    today = _today(tokens, cost, by_cost)
    if short:
        segments = [context, F.when(tokens > 0, today)]
    else:
        segments = [context, _limits(payload, now), _model(payload), today]
    whole = F.concat_ws(f"{GREY} • {RESET}", _head(payload, branch, home, short), *segments)
    return F.when(payload.isNull(), fallback(F.lit(None).cast("string"), home)).otherwise(whole)

"""HTML reports from a few collected statistics."""

from __future__ import annotations

import html
import math

SERIES = ("#2f6f8f", "#c2703d", "#4f8a4b", "#8a4f7d", "#8a7a2f", "#4b5f9a")


def pct(v: float, digits: int = 1) -> str:
    return f"{100 * v:.{digits}f} %"


def fmt_p(p: float) -> str:
    return "p < 0.001" if p < 0.001 else f"p = {p:.3f}"


def axis(v: float, most: int = 6) -> tuple[float, float]:
    """(end, step) of an axis from 0 that holds v: the least step of one, two or five times a power
    of ten that takes at most so many steps."""
    if v <= 0:
        return 1.0, 0.25
    power = 10.0 ** math.floor(math.log10(v / most))
    step = next(m * power for m in (1, 2, 5, 10) if v <= most * m * power * (1 + 1e-9))
    return math.ceil(v / step - 1e-9) * step, step


def judged_by(names: list[str]) -> str:
    """Who reviewed, each person once."""
    people = sorted(set(names))
    return "Judged by " + (", ".join(people) if people else "an unknown reviewer") + ("; their verdicts are counted together." if len(people) > 1 else ".")


def verdict_sentence(label: str, rate: float, limit: float, accepted: bool, complete: bool) -> str:
    state = "accepted" if accepted else "not accepted"
    return f"{label}: error rate {pct(rate)} against a limit of {pct(limit)}: {state}{'' if complete else ' (review not complete)'}."


def interval_chart(rows: list[dict], width: int = 640) -> str:
    """Rows of {label, rate, low, high} as whiskers with a dot; an inline SVG."""
    top, step = axis(max((r["high"] for r in rows), default=0.0))
    x = lambda v: 160 + (width - 190) * min(v / top, 1.0) if top else 160
    height = 30 * len(rows) + 30
    out = [f'<svg viewBox="0 0 {width} {height}" role="img" aria-label="error rates">']
    for i in range(round(top / step) + 1):
        out.append(f'<line x1="{x(i * step):.1f}" x2="{x(i * step):.1f}" y1="0" y2="{height - 24}" stroke="#ddd"/><text x="{x(i * step):.1f}" y="{height - 8}" text-anchor="middle" font-size="11">{pct(i * step, 0)}</text>')
    for i, r in enumerate(rows):
        y, color = 18 + 30 * i, SERIES[i % len(SERIES)]
        tip = html.escape(f"{r['label']}: {pct(r['rate'])} ({pct(r['low'])} to {pct(r['high'])})", quote=True)
        out.append(f'<g><title>{tip}</title><text x="0" y="{y + 4}" font-size="12">{html.escape(r["label"])}</text><line x1="{x(r["low"]):.1f}" x2="{x(r["high"]):.1f}" y1="{y}" y2="{y}" stroke="{color}" stroke-width="3"/><circle cx="{x(r["rate"]):.1f}" cy="{y}" r="5" fill="{color}"/></g>')
    return "".join([*out, "</svg>"])


def outcome_chart(rows: list[dict], width: int = 640) -> str:
    """Rows of {label, fixed, still, both_ok, broken} as stacked bars."""
    parts = ("fixed", "still", "both_ok", "broken")
    out = [f'<svg viewBox="0 0 {width} {34 * len(rows)}" role="img" aria-label="paired outcomes">']
    for i, r in enumerate(rows):
        n, at = max(sum(r[p] for p in parts), 1), 160.0
        out.append(f'<text x="0" y="{34 * i + 20}" font-size="12">{html.escape(r["label"])}</text>')
        for k, p in enumerate(parts):
            w = (width - 170) * r[p] / n
            out.append(f'<rect x="{at:.1f}" y="{34 * i + 6}" width="{w:.1f}" height="20" fill="{SERIES[k]}"><title>{p}: {r[p]}</title></rect>')
            at += w
    return "".join([*out, "</svg>"])


def table(rows: list[dict], columns: list[str]) -> str:
    head = "".join(f"<th>{html.escape(c)}</th>" for c in columns)
    body = "".join("<tr>" + "".join(f"<td>{html.escape(str(r.get(c, '')))}</td>" for c in columns) + "</tr>" for r in rows)
    return f"<table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>"


def page(title: str, sections: list[tuple[str, str]], footer: str = "") -> str:
    """A page of (heading, HTML) sections."""
    body = "".join(f"<section><h2>{html.escape(h)}</h2>{b}</section>" for h, b in sections)
    foot = f"<footer>{html.escape(footer)}</footer>" if footer else ""
    return f'<!doctype html><html lang="en"><meta charset="utf-8"><title>{html.escape(title)}</title><body><h1>{html.escape(title)}</h1>{body}{foot}</body></html>'


def error_report(stats: list[dict], categories: list[dict], limit: float, reviewers: list[str], settings: dict, caveats: list[str], footer: str = "") -> str:
    """Eight sections: summary, rates, acceptance, verdicts, categories, estimates, settings and
    caveats. stats: rows of error_rates with label and complete."""
    sections = [
        ("Summary", "".join(f"<p>{html.escape(verdict_sentence(s['label'], s['rate'], limit, s['accepted'], s.get('complete', True)))}</p>" for s in stats)),
        ("Error rates", interval_chart(stats)),
        ("Acceptance", table([{"domain": s["label"], "bad": s["bad"], "judged": s["judged"], "accepted": s["accepted"]} for s in stats], ["domain", "bad", "judged", "accepted"])),
        ("Verdicts", table(stats, ["label", "ok", "fix", "drop"])),
        ("Categories", table(categories, ["category", "k", "n", "rate", "low", "high"])),
        ("Estimates for the whole set", table(stats, ["label", "population", "estimates"])),
        ("Settings", table([{"setting": k, "value": v} for k, v in sorted(settings.items())], ["setting", "value"])),
        ("Caveats", "".join(f"<p>{html.escape(c)}</p>" for c in [judged_by(reviewers), *caveats])),
    ]
    return page("Error report", sections, footer)


def compare_report(stats: list[dict], transitions: list[dict], reviewers: list[str], caveats: list[str], footer: str = "") -> str:
    """Sections on outcomes, rates, tests, categories, scaling and caveats of a paired comparison."""
    sections = [
        ("Summary", "".join(f"<p>{html.escape(s['label'])}: {s['fixed']} fixed, {s['broken']} broken of {s['n']} ({fmt_p(s['p'])}).</p>" for s in stats)),
        ("Outcomes", outcome_chart(stats)),
        ("Outcome counts", table(stats, ["label", "n", "fixed", "still", "both_ok", "broken"])),
        ("Rates", interval_chart([r for s in stats for r in s.get("rates", [])])),
        ("Test", table([{"domain": s["label"], "p": fmt_p(s["p"])} for s in stats], ["domain", "p"])),
        ("Categories", table(transitions, ["category", "before", "after", "gone", "kept", "new"])),
        ("Scaling", table(stats, ["label", "changed", "compared", "est_fixed", "est_broken_max", "expected"])),
        ("Caveats", "".join(f"<p>{html.escape(c)}</p>" for c in [judged_by(reviewers), *caveats])),
    ]
    return page("Compare report", sections, footer)

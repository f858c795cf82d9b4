"""Sequential, Spark-free restatements of the rules, used as test oracles."""

from __future__ import annotations


def chains_of(spells, gap_days):
    """Lists of (listed, removed) that form one vacancy; spells sorted by start."""
    chains = []
    for listed, removed in spells:
        if chains:
            ends = [end for _, end in chains[-1]]
            if None not in ends and max(0, (listed - max(ends)).days) < gap_days:
                chains[-1].append((listed, removed))
                continue
        chains.append([(listed, removed)])
    return chains


def lower_quantile(pairs, q):
    """Smallest value whose cumulative share of positive weight reaches q."""
    kept = sorted((v, w) for v, w in pairs if w > 0)
    total = sum(w for _, w in kept)
    seen = 0.0
    for value, weight in kept:
        seen += weight
        if seen / total >= q:
            return value
    return kept[-1][0] if kept else None


def survival(rows):
    """[(day, survival, at_risk, events)] from (day, censored, weight) rows."""
    kept = [r for r in rows if r[2] > 0]
    steps, s = [], 1.0
    for day in sorted({d for d, censored, _ in kept if not censored}):
        risk = sum(w for d, _, w in kept if d >= day)
        events = sum(w for d, censored, w in kept if d == day and not censored)
        s *= 1.0 - events / risk
        steps.append((day, s, risk, events))
    return steps


def area(steps, limit):
    total, day, level = 0.0, 0, 1.0
    for step_day, step_level, *_ in steps:
        if step_day >= limit:
            break
        total += level * (step_day - day)
        day, level = step_day, step_level
    return total + level * (limit - day) if limit > 0 else 0.0

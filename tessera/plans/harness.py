"""Timing harness: scenarios run many times, judged by their 99th percentile."""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

ITERATIONS = 1000


@dataclass(frozen=True)
class Scenario:
    name: str
    threshold_ms: float
    run: Callable[[Any], Any]
    setup: Callable[[], Any] | None = None
    iterations: int = ITERATIONS


@dataclass(frozen=True)
class Result:
    name: str
    iterations: int
    p50: float
    p99: float
    least: float
    most: float
    threshold_ms: float
    passed: bool


def percentile(ascending: list[float], p: float) -> float:
    """Nearest rank."""
    return ascending[max(0, math.ceil(p / 100 * len(ascending)) - 1)]


def measure(scenario: Scenario) -> Result:
    state = scenario.setup() if scenario.setup else None
    times = []
    for _ in range(scenario.iterations):
        began = time.perf_counter()
        scenario.run(state)
        times.append((time.perf_counter() - began) * 1000)
    times.sort()
    p99 = percentile(times, 99)
    return Result(scenario.name, len(times), percentile(times, 50), p99, times[0], times[-1], scenario.threshold_ms, p99 <= scenario.threshold_ms)


def report(results: list[Result]) -> str:
    lines = [f"{'PASS' if r.passed else 'FAIL'} {r.name}: p50 {r.p50:.3f} ms, p99 {r.p99:.3f} ms (limit {r.threshold_ms:g}), min {r.least:.3f}, max {r.most:.3f}, n {r.iterations}" for r in results]
    return "\n".join([*lines, f"{sum(r.passed for r in results)} of {len(results)} passed"])


def run(scenarios: list[Scenario], silent: bool = False, exit_on_failure: bool = False) -> list[Result]:
    results = [measure(s) for s in scenarios]
    if not silent:
        print(report(results))
    if exit_on_failure and not all(r.passed for r in results):
        raise SystemExit(1)
    return results

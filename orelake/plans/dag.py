"""A small runner: steps in order of their needs, stop at the first failure, clean up always, report."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from graphlib import TopologicalSorter


@dataclass
class Step:
    name: str
    run: Callable[[dict], object]
    needs: tuple[str, ...] = ()
    always: bool = False


@dataclass
class Report:
    rows: list[tuple[str, str, float, str]] = field(default_factory=list)

    @property
    def exit_code(self) -> int:
        return int(any(s not in ("SUCCESS", "SKIPPED") for _, s, _, _ in self.rows))

    def text(self) -> str:
        return "\n".join(f"{s:8} {t:7.2f} s  {n}{'  ' + d if d else ''}" for n, s, t, d in self.rows)


def run(steps: list[Step]) -> tuple[dict, Report]:
    """Results by step name, each given to later steps, and the report."""
    by, out, report = {s.name: s for s in steps}, {}, Report()
    order = [by[n] for n in TopologicalSorter({s.name: s.needs for s in steps}).static_order()]
    failed = False
    for s in [*[s for s in order if not s.always], *[s for s in order if s.always]]:
        if failed and not s.always:
            report.rows.append((s.name, "SKIPPED", 0.0, ""))
            continue
        began = time.time()
        try:
            out[s.name] = s.run(out)
            report.rows.append((s.name, "SUCCESS", time.time() - began, ""))
        except Exception as e:  # noqa: BLE001 a step's failure is a result here
            failed = True
            report.rows.append((s.name, "FAILED", time.time() - began, f"{type(e).__name__}: {e}"[:300]))
    return out, report


def poll(fetch: Callable[[], object], done: Callable[[object], bool], timeout: float, every: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> object:
    end = time.monotonic() + timeout
    while not done(x := fetch()):
        if time.monotonic() > end:
            raise TimeoutError(str(x)[:200])
        sleep(every)
    return x


def best_of(n: int, f: Callable[[], object]) -> float:
    times = []
    for _ in range(n):
        began = time.perf_counter()
        f()
        times.append(time.perf_counter() - began)
    return min(times)

"""Registered functions, templates that user code must fit, and parameter specs."""

from __future__ import annotations

import ast
import inspect
from abc import ABC, abstractmethod
from collections.abc import Callable
from dataclasses import dataclass
from threading import Lock

from pyspark.sql import DataFrame

from ..operators import backtest, signals


class FunctionRegistry:
    """``(category, name)`` to a function ``(df, keys, order, **params) -> DataFrame``."""

    def __init__(self):
        self._found: dict[tuple[str, str], Callable] = {}
        self._lock = Lock()

    def register(self, category: str, name: str, f: Callable, replace: bool = False) -> None:
        with self._lock:
            if (category, name) in self._found and not replace:
                raise ValueError(f"{category}/{name} is there already")
            self._found[category, name] = f

    def resolve(self, category: str, name: str) -> Callable:
        try:
            return self._found[category, name]
        except KeyError:
            raise KeyError(f"no {category} named {name}; there are {self.names(category)}") from None

    def names(self, category: str) -> list[str]:
        return sorted(n for c, n in self._found if c == category)


def _fixed(df: DataFrame, *, keys, order, fraction: float = 1.0) -> DataFrame:
    from pyspark.sql import functions as F

    return df.withColumn("position", backtest.fixed_fraction(F.col("signal"), fraction))


def defaults() -> FunctionRegistry:
    """The built-in signals and sizers."""
    r = FunctionRegistry()
    for name, f in (("sma_crossover", signals.sma_crossover), ("ema_crossover", signals.ema_crossover), ("bollinger_zscore", signals.bollinger_reversion), ("zscore_spread", signals.spread_zscore), ("price_above_mean", signals.price_above_mean)):
        r.register("signals", name, f)
    for kind in signals.TaSignal.TYPES:
        r.register("signals", f"ta_{kind.lower()}", lambda df, kind=kind, **o: signals.ta_signal(df, kind, **o))
    r.register("sizing", "fixed_fraction", _fixed)
    r.register("sizing", "volatility_target", backtest.volatility_target)
    return r


class SignalTemplate(ABC):
    """User code that adds ``signal`` to bars."""

    name: str

    @abstractmethod
    def generate(self, df: DataFrame, *, keys: list[str], order: list[str], **params) -> DataFrame: ...


class SizingTemplate(ABC):
    """User code that adds ``position`` to rows with a signal."""

    name: str

    @abstractmethod
    def size(self, df: DataFrame, *, keys: list[str], order: list[str], **params) -> DataFrame: ...


class SourceTemplate(ABC):
    """User code that gives bars for tickers."""

    name: str

    @abstractmethod
    def bars(self, spark, tickers: list[str]) -> DataFrame: ...


#: Modules that user code may import.
ALLOWED = ("math", "numpy", "pandas", "pyspark", "gnomon", "__future__", "dataclasses", "typing")
TEMPLATES = {SignalTemplate: ("signals", "generate"), SizingTemplate: ("sizing", "size"), SourceTemplate: ("sources", "bars")}


def check_source(code: str) -> list[str]:
    """What is wrong with user code: imports beyond the allowed ones, and calls that run or open things."""
    out = []
    for node in ast.walk(ast.parse(code)):
        mods = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
        out += [f"import of {m}" for m in mods if m.split(".")[0] not in ALLOWED]
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in ("exec", "eval", "open", "__import__", "compile"):
            out.append(f"call of {node.func.id}")
    return out


def load_user_code(code: str, registry: FunctionRegistry) -> list[str]:
    """Registers the templates' subclasses in a piece of code; ``ValueError`` if it isn't allowed or they don't fit."""
    if wrong := check_source(code):
        raise ValueError("; ".join(wrong))
    space: dict = {"SignalTemplate": SignalTemplate, "SizingTemplate": SizingTemplate, "SourceTemplate": SourceTemplate}
    exec(compile(code, "<user code>", "exec"), space)  # noqa: S102 - checked above
    done = []
    for cls in list(space.values()):
        for base, (category, method) in TEMPLATES.items():
            if inspect.isclass(cls) and issubclass(cls, base) and cls is not base:
                if inspect.isabstract(cls) or not getattr(cls, "name", None):
                    raise ValueError(f"{cls.__name__} lacks a name or {method}")
                registry.register(category, cls.name, getattr(cls(), method))
                done.append(cls.name)
    return done


class Strategy(ABC):
    """What the three phases need of a strategy."""

    name: str

    @abstractmethod
    def models(self) -> list[str]: ...

    @abstractmethod
    def configs(self, spark) -> DataFrame: ...

    @abstractmethod
    def days(self, spark) -> DataFrame: ...

    @abstractmethod
    def features(self, spark) -> DataFrame: ...

    @abstractmethod
    def run_day(self, bars, config: dict) -> float: ...


class Engine(ABC):
    """A pure computation over frames: no reads, no writes."""

    @abstractmethod
    def compute(self, data: DataFrame, params: dict) -> DataFrame: ...


@dataclass(frozen=True)
class ParamSpec:
    """A typed parameter of a strategy."""

    name: str
    kind: type
    default: float
    low: float | None = None
    high: float | None = None
    step: float | None = None

    def check(self, value):
        value = self.kind(value)
        if (self.low is not None and value < self.low) or (self.high is not None and value > self.high):
            raise ValueError(f"{self.name} must be from {self.low} to {self.high}")
        return value

    def values(self) -> list:
        """The grid from low to high."""
        n = int(round((self.high - self.low) / self.step))
        return [self.kind(self.low + i * self.step) for i in range(n + 1)]

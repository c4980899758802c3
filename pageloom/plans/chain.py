"""The page chain (read, frame, order, translate, erase, rewrite) and the registry of engines."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame

Stage = Callable[[DataFrame], DataFrame]
NAMES = ("read", "frame", "order", "translate", "erase", "rewrite")


def cut(df: DataFrame) -> DataFrame:
    """df computed once into the cluster's shared checkpoint folder: later stages that read it twice don't make it again, and lost executors cost nothing."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="pageloom-chain-"))
    return df.checkpoint()


class Chain:
    """The six stages, in this order; each gets what the one before returned."""

    def __init__(self, **stages: Stage):
        if set(stages) != set(NAMES) or any(s is None for s in stages.values()):
            raise TypeError(f"a chain takes {', '.join(NAMES)}")
        self.stages = [stages[n] for n in NAMES]

    def run(self, pages: DataFrame) -> DataFrame:
        if pages is None:
            raise TypeError("pages is None")
        for stage in self.stages:
            pages = pages.transform(stage)
        return pages

    def again_from(self, name: str, zones: DataFrame) -> DataFrame:
        """After a correction: the stages from `name` on, over what the one before left."""
        for stage in self.stages[NAMES.index(name) :]:
            zones = zones.transform(stage)
        return zones


class Engines:
    """Engines by name, made when first asked for; unknown names are errors, never replaced."""

    def __init__(self, **makers: Callable[[], object]):
        self._makers, self._made = makers, {}

    @property
    def known(self) -> list[str]:
        return list(self._makers)

    def get(self, name: str) -> object:
        if name not in self._makers:
            raise ValueError(f"unknown engine {name}")
        if name not in self._made:
            self._made[name] = self._makers[name]()
        return self._made[name]

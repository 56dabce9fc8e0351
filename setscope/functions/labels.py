"""Chord labels: grammar, roll-up and default node orders."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from setscope.functions.tables import local_table

# The twelve root notes and the label qualities, in the default order of the circle.
ROOTS = ("C", "Db", "D", "Eb", "E", "F", "Gb", "G", "Ab", "A", "Bb", "B")
QUALITIES = ("maj", "maj7", "min", "min7", "7")
ROLLED_QUALITIES = ("maj", "min")
QUALITY_ROLL_UP = {"maj": "maj", "maj7": "maj", "min": "min", "min7": "min", "7": "maj"}


def default_labels(rolled_up: bool = False) -> list[str]:
    """60 labels by root and quality, or the 24 major/minor ones."""
    return [root + quality for root in ROOTS for quality in (ROLLED_QUALITIES if rolled_up else QUALITIES)]


def chord_roll_up(spark: SparkSession) -> DataFrame:
    """``(item, parent)``: every label and the major/minor label it rolls up to."""
    mapping = chord_parents()
    return local_table(spark, {"item": list(mapping), "parent": list(mapping.values())})


def chord_parents() -> dict[str, str]:
    return {r + q: r + p for r in ROOTS for q, p in QUALITY_ROLL_UP.items()}


def order_frame(spark: SparkSession, labels: list[str]) -> DataFrame:
    """``(node, pos)`` of a list of labels."""
    return local_table(spark, {"node": pa.array(labels, pa.string()), "pos": pa.array(range(len(labels)), pa.int32())})


def default_order(spark: SparkSession, rolled_up: bool = False) -> DataFrame:
    return order_frame(spark, default_labels(rolled_up))


def root_of(label: Column) -> Column:
    """Root note of a label: two characters when the second is a flat sign, else one."""
    return F.when(F.substring(label, 2, 1) == "b", F.substring(label, 1, 2)).otherwise(F.substring(label, 1, 1))

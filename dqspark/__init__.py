"""Measure and repair data errors in table lineages, with Spark DataFrames."""

from dqspark.operators.signals import SHAPES, Rule
from dqspark.plans.lineage import Lineage, Node, Sink, protected_run

__all__ = ["SHAPES", "Rule", "Lineage", "Node", "Sink", "protected_run"]

"""The quality report of a dataset, as related frames."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame

from ..operators import metrics as M
from ..session import settled


class QualityReport:
    """Metrics, score, problems and advice for one table.

    The facts per column, the distinct values per column and the distinct rows
    each take one scan when something first needs them; their results have a
    row per column and are kept, so no later part scans the table for them.
    """

    def __init__(self, df: DataFrame, threshold: float = M.THRESHOLD):
        self.df, self.threshold = df, threshold

    @cached_property
    def facts(self) -> DataFrame:
        return settled(M.column_facts(self.df))

    @cached_property
    def uniqueness(self) -> DataFrame:
        return settled(M.column_uniqueness(self.df))

    @cached_property
    def overall(self) -> DataFrame:
        return settled(M.overall_metrics(self.df, self.facts))

    @property
    def completeness(self) -> DataFrame:
        return M.completeness_columns(self.facts)

    @property
    def validity(self) -> DataFrame:
        return M.validity_columns(self.facts)

    @property
    def consistency(self) -> DataFrame:
        return M.consistency_columns(self.facts)

    @property
    def score(self) -> DataFrame:
        return M.quality_score(self.overall)

    @property
    def problems(self) -> DataFrame:
        return M.problematic_columns(M.column_scores(self.facts, self.uniqueness), self.threshold)

    @property
    def recommendations(self) -> DataFrame:
        return M.recommendations(self.overall, self.problems)

    @property
    def statistics(self) -> DataFrame:
        return M.column_statistics(self.df, uniqueness=self.uniqueness)

    @property
    def data_types(self) -> DataFrame:
        return M.data_type_distribution(self.df)

    @property
    def info(self) -> DataFrame:
        return M.dataset_info(self.df)

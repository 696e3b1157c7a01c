from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass
class Embedding:
    """vectors(id, vector) and, for iterative methods, (step, loss) of each step."""

    vectors: DataFrame
    history: list = field(default_factory=list)

    def history_table(self, spark) -> DataFrame:
        return spark.createDataFrame([(int(s), float(x)) for s, x in self.history], "step bigint, loss double")

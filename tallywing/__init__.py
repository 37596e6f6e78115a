"""tallywing: developer-tool usage telemetry analysed with Spark DataFrames."""

from tallywing.model import Warehouse
from tallywing.session import spark_session

__all__ = ["Warehouse", "spark_session"]

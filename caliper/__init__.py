"""caliper: classifier evaluation as Spark DataFrame operators.

Every public operator takes DataFrames plus column names and returns a
DataFrame (or a Column).  Nothing is collected to the driver except
bounded, explicitly-sized results (bucket split points, vocabulary
heads, key lists passed to ``pivot``).
"""

from caliper.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]

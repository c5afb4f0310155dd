"""Column functions: every one takes and returns Columns and stays inside the JVM."""

from rankmill.functions.numbers import *  # noqa: F401,F403
from rankmill.functions.texts import *  # noqa: F401,F403
from rankmill.functions.times import *  # noqa: F401,F403

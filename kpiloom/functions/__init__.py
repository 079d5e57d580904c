from kpiloom.functions.columns import *  # noqa: F401,F403
from kpiloom.functions.formulas import *  # noqa: F401,F403

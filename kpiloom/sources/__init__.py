from kpiloom.sources.files import (  # noqa: F401
    read_csv,
    read_fact_csv,
    write_alerts,
    write_csv,
    write_per_entity,
)
from kpiloom.sources.tables import table  # noqa: F401

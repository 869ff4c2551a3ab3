"""tenure — customer-retention analytics as Spark DataFrame operators.

Every public function takes DataFrames (plus plain parameters) and returns a
lazily planned DataFrame; nothing is collected to the driver.  The canonical
transactions frame ``T`` has the columns

    tx_id (long), driver_id (long), transaction_date (timestamp_ntz),
    amount (double), kind (string)

see :mod:`tenure.sources.schema`.
"""

from tenure.session import get_session, checkpoint_dir  # noqa: F401

__all__ = ["get_session", "checkpoint_dir"]

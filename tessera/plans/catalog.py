"""Imports every query suite so their ``@query`` registrations run."""

from . import history_suite  # noqa: F401
from . import series_suite  # noqa: F401
from . import histogram_suite  # noqa: F401
from . import fleet_suite  # noqa: F401
from . import joins_suite  # noqa: F401
from . import state_suite  # noqa: F401
from . import text_suite  # noqa: F401
from . import maintenance_suite  # noqa: F401
from . import streaming_suite  # noqa: F401
from . import hardware_suite  # noqa: F401
from . import host_suite  # noqa: F401
from . import misc_suite  # noqa: F401

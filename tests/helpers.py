from contextlib import contextmanager

import pytest

# When two stages of a plan fail at once, AQE reports only that.
SEVERAL = "Multiple failures in stage materialization"


@contextmanager
def fails(text=""):
    """The job inside must fail, naming ``text``."""
    with pytest.raises(Exception) as caught:
        yield
    message = str(caught.value)
    assert text in message or SEVERAL in message, message[:500]

"""First readable line of an error."""


def reason(error: BaseException) -> str:
    lines = [line.strip() for line in str(error).splitlines() if line.strip()]
    return lines[0] if lines else type(error).__name__

ARRIVAL = "_row_order"  # column of landed tables: (file, block, row), ascending as rows arrived

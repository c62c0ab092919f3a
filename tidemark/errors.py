"""Errors with the exit code that the command line ends with."""


class TidemarkError(Exception):
    code = 1


class UsageError(TidemarkError, ValueError):
    code = 2


class DataError(TidemarkError):
    code = 3


class FileError(TidemarkError, OSError):
    code = 4


class OverflowFault(TidemarkError, ArithmeticError):
    code = 5


#: What raise_error says on executors, to be told apart again on the driver.
OVERFLOW = "uint64 volume overflow"
NOT_FINITE = "vwap is not finite"


def translated(fault: Exception) -> TidemarkError:
    """The error of this package that a failed Spark job stands for."""
    if isinstance(fault, TidemarkError):
        return fault
    text = str(fault)
    if OVERFLOW in text or NOT_FINITE in text or "ARITHMETIC_OVERFLOW" in text:
        return OverflowFault(NOT_FINITE if NOT_FINITE in text else OVERFLOW)
    if any(x in text for x in ("CRC checksum", "ChecksumException", "not a Parquet file", "FAILED_READ_FILE", "CANNOT_READ_FILE", "ParquetDecodingException", "Could not read", "EOFException", "UNABLE_TO_INFER_SCHEMA")):
        return DataError(f"unreadable partition: {text.splitlines()[0][:300]}")
    return TidemarkError(text.splitlines()[0][:500] if text else type(fault).__name__)

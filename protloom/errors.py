"""Errors of the index; the message texts are part of the interface."""

from __future__ import annotations


class IndexError_(Exception):
    """Any failure of an index operation."""

    template = "{0}"

    def __init__(self, *args: object):
        super().__init__(self.template.format(*args))
        self.values = args


def _kind(name: str, template: str, doc: str) -> type[IndexError_]:
    return type(name, (IndexError_,), {"template": template, "__doc__": doc})


# Fixed message texts.
DatabaseError = _kind("DatabaseError", "Database error: {0}", "The storage failed.")
InvalidMoltype = _kind("InvalidMoltype", "Invalid molecular type: {0}", "No such alphabet.")
SerializationError = _kind("SerializationError", "Serialization error: {0}", "Stored data cannot be read.")
InvalidAminoAcid = _kind("InvalidAminoAcid", "Invalid amino acid '{0}' found at position {1}", "A residue that is no letter of the alphabet.")
LockError = _kind("LockError", "Lock acquisition failed: {0}", "Another writer holds the index.")
InvalidKsize = _kind("InvalidKsize", "Invalid k-mer size: {0}", "A k-mer size out of range.")
NoSavedState = _kind("NoSavedState", "No saved state found in database", "The path holds no index.")
IoError = _kind("IoError", "IO error: {0}", "A file cannot be read or written.")
Utf8Error = _kind("Utf8Error", "UTF-8 error: {0}", "Bytes that are no text.")
FastaParsing = _kind("FastaParsing", "FASTA parsing error: {0}", "A file that is no FASTA.")
BuilderError = _kind("BuilderError", "Builder error: {0}", "A setting is missing.")
SketchError = _kind("SketchError", "Sketch error: {0}", "A sketch cannot be made.")
ParseError = _kind("ParseError", "Parse error: {0}", "A value cannot be parsed.")
OtherError = _kind("OtherError", "Other error: {0}", "Anything else.")
ValidationError = _kind("ValidationError", "Validation error: {0}", "A check failed.")
ConfigurationError = _kind("ConfigurationError", "Configuration error: {0} - {1}", "A setting is wrong.")
PerformanceWarning = _kind("PerformanceWarning", "Performance warning: {0}", "A setting is slow.")


def with_context(error: Exception, context: str) -> IndexError_:
    """The error as a failed check, with its context before it; a failed check's own prefix is not repeated."""
    inner = error.values[0] if isinstance(error, ValidationError) else error
    return ValidationError(f"{context}: {inner}")


def with_field_context(error: Exception, field: str, message: str) -> IndexError_:
    """The error as a wrong setting."""
    return ConfigurationError(field, f"{message}: {error}")

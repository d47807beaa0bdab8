"""Errors and warnings that callers tell apart."""


class FormatError(ValueError):
    """A raw export holds no readable block."""


class PathNotFound(FileNotFoundError):
    """No such file or folder."""


class NotAFilesystemPath(ValueError):
    """A URL or another thing that is no path."""


class NoSessionFolders(ValueError):
    """A root without session folders."""


class NoSignalSessions(ValueError):
    """A root whose folders hold no signal session."""


class NoStabilizationFiles(ValueError):
    """A root without stabilization files."""


class UnparsedFileWarning(UserWarning):
    """A file name that isn't understood."""


class PartialRedoWarning(UserWarning):
    """A device with redone and original files side by side."""


class EmptySessionWarning(UserWarning):
    """A session that gave no row."""


class EmptySessionError(ValueError):
    """The same, when asked to be an error."""


class PinMismatch(ValueError):
    """Data that doesn't fit the pinned parameters."""


class DemoTreeNotFound(FileNotFoundError):
    """No demonstration tree, and none was to be made."""

"""Operations of a large-scale text-corpus pipeline; nothing else in the library imports this subpackage."""

"""The same operators over streams, with keyed state and sinks."""

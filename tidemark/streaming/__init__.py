"""The ordered operations of a queue: one state machine for replay and for streams."""

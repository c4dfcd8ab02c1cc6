"""Windows over events, idempotent streams and a stateful limiter."""

"""Row-wise operators over streams; the engine has no stateful streaming operator."""

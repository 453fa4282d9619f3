"""Tables, their schemas, and readers and writers."""

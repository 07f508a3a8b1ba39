"""The session comes from the tests' own conftest."""

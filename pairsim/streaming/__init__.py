"""The stateless scoring path over a stream of pairs."""

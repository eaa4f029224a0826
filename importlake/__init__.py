"""Trade and retail-sourcing analytics as DataFrame operators."""

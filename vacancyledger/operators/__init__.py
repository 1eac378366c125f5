"""DataFrame -> DataFrame operators. None of them triggers an action unless its text says so."""

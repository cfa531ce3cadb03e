"""The seed stations of the synthetic source."""

from __future__ import annotations

# ---- fixed values: station and base temperature in degrees ----
SEED_STATIONS = """
Abha 18.0
Abidjan 26.0
Adelaide 17.3
Algiers 18.2
Amsterdam 10.2
Ankara 12.0
Athens 19.2
Auckland 15.2
Bangkok 28.6
Barcelona 18.2
Beijing 12.9
Beirut 20.9
Belgrade 12.5
Berlin 10.3
Bogota 13.5
Boston 10.9
Brasilia 21.4
Brisbane 21.4
Brussels 10.5
Budapest 11.3
Buenos Aires 17.7
Cairo 22.1
Calgary 4.4
Cape Town 17.3
Casablanca 17.6
Chicago 10.8
Copenhagen 9.1
Da Nang 26.5
Dallas 19.0
Damascus 17.0
Delhi 25.0
Denver 10.4
Dhaka 25.9
Dubai 28.2
Dublin 9.8
Edinburgh 9.3
Frankfurt 10.6
Geneva 11.0
Hamburg 9.7
Hanoi 24.2
Helsinki 5.9
Ho Chi Minh City 27.8
Hong Kong 23.3
Honolulu 25.4
Houston 21.4
Istanbul 14.5
Jakarta 27.5
Jerusalem 17.5
Johannesburg 16.0
Kabul 13.0
Karachi 26.0
Kathmandu 18.3
Kyiv 8.4
Kuala Lumpur 27.3
Lagos 26.8
Lahore 24.3
Lima 19.3
Lisbon 17.5
London 11.3
Los Angeles 18.6
Madrid 15.0
Manila 28.4
Melbourne 15.1
Mexico City 16.1
Miami 25.1
Milan 13.0
Montreal 6.8
Moscow 5.8
Mumbai 27.4
Nairobi 17.8
New York 12.7
Oslo 6.4
Paris 12.3
Prague 9.1
Reykjavik 4.8
Rio de Janeiro 24.2
Rome 15.8
San Francisco 14.0
Seoul 12.5
Singapore 27.6
Stockholm 7.0
Sydney 17.7
Taipei 23.0
Tokyo 15.4
Toronto 9.4
Vancouver 10.4
Vienna 10.4
Warsaw 8.5
Washington 14.5
Zurich 9.3
"""


def seed_stations() -> list[tuple[str, float]]:
    """(name, base temperature) in order."""
    return [(name, float(base)) for name, _, base in (line.rpartition(" ") for line in SEED_STATIONS.strip().splitlines())]

from riskloom.queries import (  # noqa: F401
    q_a_sources,
    q_b_clean,
    q_c_joins,
    q_d_aggregates,
    q_e_windows,
    q_f_ranking,
    q_g_sets,
    q_h_functions,
    q_i_text,
    q_j_history,
    q_k_learning,
    q_l_plans,
    q_m_tables,
    q_n_daily,
)
from riskloom.queries.registry import QUERIES, SQL  # noqa: F401
